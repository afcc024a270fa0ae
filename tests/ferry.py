"""The exports of an invented ferry line, made from a seed, and faults that can be planted in them.

A fault changes the tables and says which issues must come of it, so a test can plant any set of them.
"""

import csv
import random
from dataclasses import dataclass, field

AS_OF = "2026-03-12"
DAYS = [f"{d} 03/{k:02}" for d, k in zip(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), range(2, 9))]
WATCHES = ("6a-2p", "2p-10p", "10p-6a", "8a-8p")
ASHORE = "ashore"
LEGEND = "6a-2p, 2p-10p and 10p-6a count 8 hours; 8a-8p counts 12 hours"
PORTS = {"OST": "Osterhaven", "KLI": "Klintvik", "SAN": "Sandholm"}
DUTIES = {"SKIP": "Skipper", "MATE": "Mate", "ENG": "Engineer", "DECK": "Deckhand"}
CREW = ["crew number", "given name", "family name", "duty", "home port", "mobile phone", "certificate held", "certificate ends", "joined"]
WAGES = ["slip no", "paid to", "wage class", "home port", "week begins", "week ends", "hours"]
REGISTRY = ["cert no", "holder", "cert grade", "valid to", "looked up"]
FILES = {"crew": "crew list.csv", "wages": "wages.csv", "registry": "register.csv"}


def _word(rng, size):
    return "".join(rng.choice("aeiou" if k % 2 else "bdfgklmnrstv") for k in range(size)).capitalize()


@dataclass
class Ferry:
    """One row per hand in each table; ``watches`` has name, duty, port and a code per day."""

    crew: list = field(default_factory=list)
    wages: list = field(default_factory=list)
    registry: list = field(default_factory=list)
    watches: list = field(default_factory=list)
    headers: dict = field(default_factory=lambda: {"crew": list(CREW), "wages": list(WAGES), "registry": list(REGISTRY)})

    @classmethod
    def build(cls, seed=1, hands=21):
        rng, out = random.Random(seed), cls()
        for k in range(hands):
            given = {1: "Katharina", 2: "Nikolaus"}.get(k, _word(rng, 6))
            family, duty, port = _word(rng, 9 + k % 2), list(DUTIES)[k % 4], list(PORTS)[k % 3]
            number, cert = f"K{1000 + 7 * k}", f"{rng.choice('ABC')}{rng.choice('XYZ')}-{rng.randrange(10_000, 100_000)}"
            until, joined = f"{2027 + k % 2}-{1 + k % 12:02}-{10 + k % 15}", f"20{10 + k % 14}-0{1 + k % 9}-1{k % 10}"
            out.crew.append([number, given, family, DUTIES[duty], PORTS[port], f"718 555 {1200 + k}", cert, until, joined])
            out.registry.append([cert, f"{given} {family}", duty, until, "2026-02-20"])
            long = k % 5 == 4
            codes = [WATCHES[3] if long else WATCHES[k % 3]] * (3 if long else 5) + [ASHORE] * (4 if long else 2)
            codes = codes[k % 7 :] + codes[: k % 7]
            out.watches.append([f"{given} {family}", duty, port, codes])
            out.wages.append([f"W{500 + k}", f"{family}, {given}", duty, PORTS[port], "2026-03-02", "2026-03-08", "36" if long else "40"])
        return out

    def key(self, k):
        return f"crew:{self.crew[k][0]}"

    def pages(self, year=""):
        out = []
        for number, (port, title) in enumerate(PORTS.items(), 1):
            rows = [f"{name} {duty} {' '.join(codes)}" for name, duty, at, codes in self.watches if at == port]
            out.append(("watch bill.pdf", 90, number, "\n".join([title, f"Watches of the week {year}".strip(), f"Staff Role {' '.join(DAYS)}", *rows, LEGEND]), None))
        return out

    def write(self, folder):
        """CSV files in ``folder``; the pages of the watch bill are returned."""
        folder.mkdir(parents=True, exist_ok=True)
        for table, name in FILES.items():
            with open(folder / name, "w", newline="", encoding="utf-8") as f:
                csv.writer(f).writerows([self.headers[table], *getattr(self, table)])
        return self.pages()


def entered_twice(f, k):
    f.crew.append(list(f.crew[k]))
    return {("duplicate_key", f.key(k))}


def joins_next_year(f, k):
    f.crew[k][8] = "2027-03-01"
    return {("future_date", f.key(k))}


def paid_far_too_much(f, k):
    f.wages[k][6] = "96"
    return {(r, f.key(k)) for r in ("numeric_range", "hours_reconcile", "overtime")}


def week_backwards(f, k):
    f.wages[k][4:6] = ["2026-03-08", "2026-03-02"]
    return {("date_order", f.key(k)), ("hours_reconcile", f.key(k))}


def paid_a_stranger(f, k):
    f.wages.append(["W999", "Quillfeather, Zebulon", "DECK", "Sandholm", "2026-03-02", "2026-03-08", "16"])
    return {("not_in_anchor", "wages:zebulon quillfeather")}


def unpaid(f, k):
    f.wages[k] = None
    return {("missing_from", f.key(k))}


def no_certificate(f, k):
    f.crew[k][6] = f.crew[k][7] = ""
    f.registry[k] = None
    return {("missing_value", f.key(k))}


def register_says_another_day(f, k):
    f.registry[k][3] = "2027-12-24"
    return {("field_conflict", f.key(k))}


def lapsed_in_the_week(f, k):
    f.crew[k][7] = f.registry[k][3] = "2026-03-01"
    return {("expiry", f.key(k)), ("activity_after_expiry", f.key(k))}


def lapses_soon(f, k):
    f.crew[k][7] = f.registry[k][3] = "2026-03-20"
    return {("expiry", f.key(k))}


def not_looked_up(f, k):
    f.registry[k][4] = "2025-12-01"
    return {("stale", f.key(k))}


def on_two_quays(f, k):
    name, duty, port, codes = f.watches[k]
    day = next(d for d, c in enumerate(codes) if c != ASHORE)
    f.watches.append([name, duty, next(p for p in PORTS if p != port), [codes[day] if d == day else ASHORE for d in range(7)]])
    return {("overlap", f.key(k)), ("field_conflict", f.key(k)), ("hours_reconcile", f.key(k))}


def strange_watch(f, k):
    codes = f.watches[k][3]
    codes[next(d for d, c in enumerate(codes) if c != ASHORE)] = "ANCHORED"
    return {("invalid_value", f.key(k)), ("hours_reconcile", f.key(k))}


def initial_on_the_slip(f, k):
    family, given = f.wages[k][1].split(", ")
    f.wages[k][1] = f"{family}, {given[0]}."
    own = f"wages:{given[0]} {family}".lower()
    return {("possible_match", own), ("not_in_anchor", own), ("missing_from", f.key(k))}


def short_name_on_the_bill(f, k):
    f.watches[k][0] = f.watches[k][0].replace("Katharina", "Kate").replace("Nikolaus", "Niko")
    return set()


def date_with_slashes(f, k):
    f.crew[k][8] = "17/11/2015"
    return {("invalid_value", f.key(k))}


def no_port(f, k):
    f.crew[k][4] = ""
    return {("required", f.key(k))}


def other_duty_in_the_register(f, k):
    f.registry[k][2] = "DECK" if f.crew[k][3] != "Deckhand" else "ENG"
    return {("field_conflict", f.key(k))}


def locker_column(f, k):
    f.headers["crew"].append("locker")
    f.crew = [[*r, "L1"] for r in f.crew]
    return {("unknown_column", None)}


def quay_column(f, k):
    f.headers["wages"][3] = "Quay"
    return {("renamed_column", None)}


FAULTS = (
    initial_on_the_slip, short_name_on_the_bill, entered_twice, joins_next_year, paid_far_too_much, week_backwards, paid_a_stranger, unpaid, no_certificate,
    register_says_another_day, lapsed_in_the_week, lapses_soon, not_looked_up, on_two_quays, strange_watch, date_with_slashes, no_port, other_duty_in_the_register, locker_column, quay_column,
)


def faulty(seed=1):
    """A line with every fault, each at a hand of its own, the issues that must come, and who has which fault."""
    f, want, at = Ferry.build(seed), set(), {}
    for k, fault in enumerate(FAULTS):
        want |= fault(f, k)
        at[fault.__name__] = f.key(k)
    f.wages, f.registry = ([r for r in rows if r is not None] for rows in (f.wages, f.registry))
    return f, want, at
