"""Raw columns to typed, normalized records in one generated projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, Field
from ..functions import names, text
from ..functions.dates import is_non_iso, parse_date

ERRORS = "array<struct<field:string,message:string>>"
SHIFTS = "array<struct<date:date,code:string,status:string,start:double,end:double,hours:double>>"
#: Derived parts of a record, beside its canonical fields.
DERIVED = {"display": "string", "name_key": "string", "reformatted": "array<string>", "shifts": SHIFTS}


def norm_schema(cfg: Config) -> str:
    fields = [*cfg.columns.items(), *((f"_{k}", v) for k, v in DERIVED.items())]
    return "struct<" + ",".join(f"`{k}`:{v}" for k, v in fields) + ">"


def record_schema(cfg: Config) -> str:
    return (
        "record_key string, source string, file string, row_ref string, file_ord int, ord long, "
        f"raw map<string,string>, norm {norm_schema(cfg)}, errors {ERRORS}"
    )


def _typed(cfg: Config, f: Field, raw: Column) -> Column:
    kind, _, name = f.type.partition(":")
    if kind == "date":
        return parse_date(raw, cfg.date_order)
    if kind == "number":
        return text.parse_number(raw)
    if kind == "phone":
        return text.parse_phone(raw)
    if kind == "identifier":
        spec = cfg.identifiers.get(name, {})
        return text.parse_identifier(raw, spec.get("pattern"), bool(spec.get("dash")))
    if kind == "code" and name in cfg.codes:
        return text.parse_code(raw, cfg.codes[name])
    value = text.clean(raw)
    return text.parsed(F.when(value != "", value))


def normalize(cfg: Config, source: str, rows: DataFrame) -> DataFrame:
    """Rows with a string column ``f_<field>`` for each mapped field get ``norm`` and ``errors``; other columns stay."""
    fields = cfg.sources[source].fields
    have = lambda f: F.col(f"f_{f}") if f"f_{f}" in rows.columns else F.lit(None).cast("string")
    # Parsed once into columns of their own, so that no parser is evaluated for value and error separately.
    rows = rows.select("*", *[_typed(cfg, f, have(n)).alias(f"p_{n}") for n, f in fields.items()])
    errors = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"p_{n}.error").isNotNull(), F.struct(F.lit(n).alias("field"), F.col(f"p_{n}.error").alias("message")))
                for n in fields
            ]
        )
    )
    dates = [n for n, f in fields.items() if f.type == "date"]
    reformatted = F.array_compact(F.array(*[F.when(F.col(f"p_{n}.value").isNotNull() & is_non_iso(have(n)), F.lit(n)) for n in dates])) if dates else F.array()
    kinds = {f.type: n for n, f in fields.items()}
    name = F.lit(None).cast("struct<display:string,key:string>")
    if "person_name" in kinds:
        name = text.let(names.split_name(have(kinds["person_name"])), lambda n: names.build_name(n["first"], n["last"], cfg.nicknames))
    elif "first_name" in kinds or "last_name" in kinds:
        part = lambda k: text.clean(have(kinds[k])) if k in kinds else F.lit("")
        name = names.build_name(part("first_name"), part("last_name"), cfg.nicknames)
    rows = rows.withColumn("_name", name)
    columns = [(F.col(f"p_{n}.value") if n in fields else F.lit(None)).cast(t).alias(n) for n, t in cfg.columns.items()]
    derived = {
        "display": F.col("_name.display"),
        "name_key": F.col("_name.key"),
        "reformatted": reformatted.cast("array<string>"),
        "shifts": F.lit(None).cast(SHIFTS),
    }
    norm = F.struct(*columns, *[derived[k].cast(t).alias(f"_{k}") for k, t in DERIVED.items()])
    kept = [c for c in rows.columns if not c.startswith(("f_", "p_")) and c != "_name"]
    return rows.select(*kept, norm.alias("norm"), errors.cast(ERRORS).alias("errors"))
