"""Small packages, each with a few changes at once, and the places where they provably break: the checker's golden corpus.

A scenario is a text: `== path` begins a file as it was, `=> path` the same file after the change, `=x path`
says that it is gone. Where the change breaks something, the line says so itself: `#! severity word`; the
word is in the finding's text. Everything else in a scenario is a control: a finding there is wrong.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_HEAD = re.compile(r"^=([=>x]) (\S+)\n", re.MULTILINE)
_MARK = re.compile(r"#! (\w+) ?(\w*)$")


@dataclass(frozen=True)
class Scenario:
    """files at the base, what the change makes of some of them (None: deleted), golden (path, line, keyword, severity)."""

    files: dict[str, str]
    change: dict[str, str | None]
    golden: list[tuple[str, int, str, str]] = field(default_factory=list)

    @staticmethod
    def of(text: str) -> Scenario:
        parts = _HEAD.split(text.lstrip("\n"))[1:]
        files, change = {}, {}
        for kind, path, body in zip(parts[::3], parts[1::3], parts[2::3], strict=True):
            if kind == "=":
                files[path] = body
            else:
                change[path] = body if kind == ">" else None
        after = {p: src for p, src in (files | change).items() if src is not None}
        marks = [(p, n, _MARK.search(line)) for p, src in after.items() for n, line in enumerate(src.splitlines(), 1)]
        return Scenario(files, change, [(p, n, m[2], m[1]) for p, n, m in marks if m])


SCENARIOS: dict[str, Scenario] = {
    # A parameter that is asked for now, in three styles of call, and a function that is gone.
    "ledger_posting": Scenario.of("""
== ledger/__init__.py
== ledger/core.py
import datetime


def post(entry, account):
    return datetime.date.today(), entry, account


def void(entry):
    return post(entry, "void")


def close_month(entries):
    return sum(entries)
=> ledger/core.py
import datetime


def post(entry, account, currency):
    return datetime.date.today(), entry, account, currency


def void(entry):
    return post(entry, "void", "EUR")
== ledger/books.py
from ledger.core import close_month, post


class Book:
    def __init__(self, owner):
        self.owner = owner
        self.entries = []

    def write(self, *amounts):
        for amount in amounts:
            self.entries.append(amount)
            post(amount, self.owner)  #! high currency

    def total(self):
        return close_month(self.entries)  #! critical removed
== ledger/audit.py
import ledger.core as core

LIMIT = 100


def suspicious(entries):
    return [core.post(e, "audit") for e in entries if e > LIMIT]  #! high currency


def replay(rows):
    return [core.post(*row) for row in rows]
"""),
    # Two modules change at once: a keyword has a new name, and a parameter goes by place only, without its default.
    "map_sheets": Scenario.of("""
== atlas/__init__.py
== atlas/raster.py
def tile(zoom, image, *, margin=2):
    return zoom, image, margin
=> atlas/raster.py
def tile(zoom, image, *, padding=2):
    return zoom, image, padding
== atlas/page.py
PAGES = {}


def render(template, values=None):
    return PAGES[template], values
=> atlas/page.py
PAGES = {}


def render(template, values, /):
    return PAGES[template], values
== atlas/sheets.py
from atlas.page import render
from atlas.raster import tile


def print_all(places, **options):
    for spot in places:
        image = render("legend", values=spot)  #! high values
        tile(spot, image, margin=1)  #! high margin
        frame = render("border")  #! high values
        tile(spot, frame)
        tile(spot, frame, **options)
"""),
    # A method asks for more: its callers through instances and subclasses, and an override that stays behind.
    "probe_family": Scenario.of("""
== probes/__init__.py
== probes/base.py
class Probe:
    unit = ""

    def read(self, channel):
        return channel

    def twice(self):
        return self.read(0), self.read(1)
=> probes/base.py
class Probe:
    unit = ""

    def read(self, channel, scale):
        return channel * scale

    def twice(self):
        return self.read(0, 1), self.read(1, 1)
== probes/thermo.py
from probes.base import Probe


class Thermo(Probe):
    unit = "K"

    def is_warm(self):
        return self.read(3) > 290  #! high scale
== probes/hygro.py
from probes.base import Probe


class Hygro(Probe):
    unit = "%"

    def read(self, channel):  #! high diverges
        return channel / 100
== probes/station.py
from probes.hygro import Hygro
from probes.thermo import Thermo


def report(damp: Hygro):
    warm = Thermo()
    return warm.read(1), damp.read(2)  #! high scale
"""),
    # A call has to be awaited now; a list became a generator, which no call site proves.
    "feed_loading": Scenario.of("""
== feed/__init__.py
== feed/load.py
def fetch(url):
    return url


def rows(text):
    return text.split()
=> feed/load.py
async def fetch(url):
    return url


def rows(text):
    for part in text.split():
        yield part
== feed/app.py
from feed.load import fetch, rows


def now(url):
    body = fetch(url)  #! high await
    return len(rows(body))


async def later(url):
    return await fetch(url)
"""),
    # An attribute is gone, for readers of the class and of one subclass; another one lives on as a property.
    "order_fields": Scenario.of("""
== shopfront/__init__.py
== shopfront/order.py
class Order:
    def __init__(self, lines, discount):
        self.lines = lines
        self.discount = discount
        self.total = sum(lines)
=> shopfront/order.py
class Order:
    def __init__(self, lines):
        self.lines = lines

    @property
    def total(self):
        return sum(self.lines)
== shopfront/kinds.py
from shopfront.order import Order


class Rush(Order):
    fee = 5


class Gift(Order):
    def discount(self):
        return 0
== shopfront/till.py
from shopfront.kinds import Gift, Rush
from shopfront.order import Order


def due(order: Order):
    return order.total - order.discount  #! high discount


def due_at_once(order: Rush):
    return order.total + order.fee - order.discount  #! high discount


def wrapped(order: Gift):
    return order.discount() + order.total
"""),
    # A default and a parameter are gone; a decorator hides what a third function takes.
    "pool_limits": Scenario.of("""
== pool/__init__.py
== pool/limits.py
from contextlib import contextmanager


def acquire(pool, timeout=5):
    return pool, timeout


def release(pool, conn, hard):
    return pool, conn, hard


@contextmanager
def lease(pool, n):
    yield pool, n
=> pool/limits.py
from contextlib import contextmanager


def acquire(pool, timeout):
    return pool, timeout


def release(pool, conn):
    return pool, conn


@contextmanager
def lease(pool, n, timeout):
    yield pool, n, timeout
== pool/user.py
from pool.limits import acquire, lease, release


def work(pool):
    conn = acquire(pool)  #! high timeout
    release(pool, conn, True)  #! high positional
    with lease(pool, 1) as more:
        return acquire(more, 2), acquire(more, timeout=3)
"""),
    # Nothing breaks: new bodies, something optional, arguments that nobody can count, and a name of another module.
    "quiet_edits": Scenario.of("""
== quiet/__init__.py
== quiet/tools.py
def scale(x, by):
    return x * by


def label(x, width):
    return str(x)[:width]


def frame(x, left, right):
    return left, x, right


def dumps(x):
    return str(x)
=> quiet/tools.py
def scale(x, by):
    product = by * x
    return product


def label(x, width, *, fill=" "):
    return str(x)[:width].ljust(width, fill)


def frame(x, left, right, below):
    return left, x, right, below
== quiet/use.py
from json import dumps

from quiet.tools import frame, label, scale


def show(x, sides, **rest):
    frame(*sides)
    frame(x, **rest)
    return dumps(label(scale(x, 2), 10))
"""),
}


def snapshots(spark: SparkSession, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(repo, path, src) before and after, a repository for each scenario: unchanged files, changed ones, without the deleted."""
    old, new = [], []
    for name in only or SCENARIOS:
        s = SCENARIOS[name]
        old += [(name, p, src) for p, src in s.files.items()]
        new += [(name, p, src) for p, src in (s.files | s.change).items() if src is not None]
    schema = "repo string, path string, src string"
    return spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)


def golden(spark: SparkSession) -> DataFrame:
    rows = [(name, p, line, keyword, i) for name, s in SCENARIOS.items() for i, (p, line, keyword, _) in enumerate(s.golden)]
    return spark.createDataFrame(rows, "repo string, path string, line long, keyword string, ord int")


def findings(spark: SparkSession) -> DataFrame:
    """The static findings of all scenarios, checked together as so many repositories."""
    from deltaloom.operators.staging import stage
    from deltaloom.plans import check

    ix = check.build_index(*snapshots(spark), stage=stage)
    return check.findings(ix).withColumnRenamed("repo", "scenario")


def golden_sql() -> str:
    """The golden places as a VALUES table."""
    rows = ", ".join(f"('{name}', '{p}', {line}, '{severity}')" for name, s in SCENARIOS.items() for p, line, _, severity in s.golden)
    return f"select scenario, file, line::int as line, severity from (values {rows}) t(scenario, file, line, severity)"
