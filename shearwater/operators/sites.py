"""Site strategies as table functions: what to read from a page is a row of a table, joined to pages by host.

A strategy is a small declaration (rows of a list, or labelled fields of a
detail page) with a hook for what only one site needs.  ``site_records`` is
called LATERAL from SQL, one parse a page, without any shuffle; ``site_check``
takes a table partitioned by host and reports how each site fares.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import ClassVar
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import html as H
from ..functions import web
from ..session import ready
from .details import _squeezed
from .extract import Spec

#: (record, url, root of the page) -> record.
Hook = Callable[[dict[str, str], str, H.Node], dict[str, str]]


class Strategy(ABC):
    """From a parsed page to records.  Concrete kinds name themselves, each name once."""

    kinds: ClassVar[dict[str, type[Strategy]]] = {}
    kind: ClassVar[str] = ""
    post: tuple[str, ...] = ()
    #: Character references that are decoded; None is all that HTML knows.
    references: Sequence[str] | None = None

    def __init_subclass__(cls, **more) -> None:
        super().__init_subclass__(**more)
        if getattr(cls.records, "__isabstractmethod__", False):
            return
        if not cls.kind:
            raise TypeError(f"{cls.__name__} must name its kind")
        taken = cls.kinds.get(cls.kind)
        # dataclass(slots=True) and reloading make a class anew under its own name
        if taken is not None and taken.__qualname__ != cls.__qualname__:
            raise ValueError(f"{cls.kind} is registered twice")
        cls.kinds[cls.kind] = cls

    @abstractmethod
    def records(self, root: H.Node, url: str) -> list[dict[str, str]]:
        """Records in page order; none is an empty list; ``LookupError`` where the page isn't what it should be."""

    @abstractmethod
    def text(self) -> str:
        """The declaration as JSON, as ``from_text`` reads it."""

    @staticmethod
    def from_text(kind: str, text: str) -> Strategy:
        if kind not in Strategy.kinds:
            raise ValueError(f"no strategy is called {kind}")
        return Strategy.kinds[kind](**json.loads(text))


def _field(how: Mapping | str | int) -> Mapping | str | int:
    if isinstance(how, Mapping):
        if not (how.get("selector") or how.get("label")) or set(how) - {"selector", "label", "attr"}:
            raise ValueError(f"a field needs a selector or a label: {how}")
        if how.get("selector"):
            H.matches(H.Node("a", {}), how["selector"].split()[-1])
    return how


@dataclass(frozen=True)
class Rows(Strategy):
    """Each element that ``rows`` selects is a record; fields are selectors below it (with an attribute) or cell numbers."""

    kind: ClassVar[str] = "rows"
    rows: str
    fields: Mapping[str, Mapping | str | int]
    skip_first: bool = False
    post: Sequence[str] = ()
    references: Sequence[str] | None = None

    def __post_init__(self) -> None:
        for how in self.fields.values():
            _field({"selector": how} if isinstance(how, str) and how != "." else how)
        object.__setattr__(self, "spec", Spec(
            self.rows, {f: how["selector"] if isinstance(how, Mapping) else how for f, how in self.fields.items()}, self.skip_first,
            {f: how["attr"] for f, how in self.fields.items() if isinstance(how, Mapping) and how.get("attr")},
        ))

    def text(self) -> str:
        return json.dumps({"rows": self.rows, "fields": self.fields, "skip_first": self.skip_first, "post": list(self.post), "references": self.references}, ensure_ascii=False, sort_keys=True)

    def records(self, root: H.Node, url: str) -> list[dict[str, str]]:
        return self.spec.records(root)


@dataclass(frozen=True)
class Detail(Strategy):
    """One record a page; fields by label (one of several) in definition lists and header cells, or by selector."""

    kind: ClassVar[str] = "detail"
    fields: Mapping[str, Mapping]
    post: Sequence[str] = ()
    references: Sequence[str] | None = None

    def __post_init__(self) -> None:
        if not self.fields or not all(isinstance(how, Mapping) for how in self.fields.values()):
            raise ValueError("a detail page needs fields, each with a label or a selector")
        for how in self.fields.values():
            _field(how)

    def text(self) -> str:
        return json.dumps({"fields": self.fields, "post": list(self.post), "references": self.references}, ensure_ascii=False, sort_keys=True)

    def records(self, root: H.Node, url: str) -> list[dict[str, str]]:
        pairs = None
        out = {}
        for name, how in self.fields.items():
            if how.get("selector"):
                hit = next(iter(H.select(root, how["selector"])), None)
                out[name] = "" if hit is None else hit.attrs.get(how["attr"], "") if how.get("attr") else hit.text()
                continue
            pairs = list(labels(root)) if pairs is None else pairs
            names = [how["label"]] if isinstance(how["label"], str) else how["label"]
            out[name] = labelled(pairs, names)
        return [out]


def labels(root: H.Node) -> Iterator[tuple[str, str]]:
    """Terms with the next definition among their siblings, then header cells with the next data cell."""
    for head, body in (("dt", "dd"), ("th", "td")):
        for n in root.walk():
            if n.tag != head:
                continue
            kids = n.parent.kids
            at = next(i for i, k in enumerate(kids) if k is n)
            value = next((k for k in kids[at + 1 :] if isinstance(k, H.Node) and k.tag == body), None)
            if value is not None:
                yield _squeezed(n), _squeezed(value)


def labelled(pairs: Sequence[tuple[str, str]], names: Sequence[str]) -> str:
    """The first value whose label is one of ``names``, in their order; then of one that holds one; '' without any."""
    for test in (lambda label, name: label == name, lambda label, name: name in label):
        for name in names:
            for label, value in pairs:
                if value and test(label, name):
                    return value
    return ""


def absolute_links(record: dict[str, str], url: str, root: H.Node) -> dict[str, str]:
    """``href`` against the page's URL."""
    return {**record, "href": urljoin(url, record["href"])} if record.get("href") else record


def species_from_url(record: dict[str, str], url: str, root: H.Node) -> dict[str, str]:
    """An empty species from the URL's words."""
    low = url.lower()
    kind = next((k for k, words in (("犬", ("/dog", "/inu")), ("猫", ("/cat", "/neko"))) if any(w in low for w in words)), "")
    return record if record.get("species") else {**record, "species": kind}


#: Hooks that every session knows.
HOOKS: dict[str, Hook] = {"absolute_links": absolute_links, "species_from_url": species_from_url}


class _Reader:
    """Strategies by their declaration, each read once a task, and records with their errors as values."""

    def __init__(self, hooks: Mapping[str, Hook]):
        self.hooks, self.known = hooks, {}

    def strategy(self, kind: str, spec: str) -> tuple[Strategy | None, list[Hook], str | None]:
        if (kind, spec) not in self.known:
            try:
                made = Strategy.from_text(kind, spec)
                missing = [h for h in made.post if h not in self.hooks]
                self.known[kind, spec] = (made, [self.hooks[h] for h in made.post if h in self.hooks], f"no hook is called {missing[0]}" if missing else None)
            except (ValueError, TypeError, KeyError) as e:
                self.known[kind, spec] = (None, [], f"invalid strategy: {e}")
        return self.known[kind, spec]

    def read(self, kind: str | None, spec: str | None, url: str | None, html: str | None) -> tuple[str, list[dict[str, str]], str | None]:
        """(status, records, error) of a page."""
        if kind is None or spec is None:
            return "no_adapter", [], "no strategy for this host"
        made, hooks, wrong = self.strategy(kind, spec)
        if wrong:
            return "init_error", [], wrong
        if html is None:
            return "fetch_error", [], "no page"
        try:
            root = H.parse(html, made.references)
            found = made.records(root, url or "")
            for hook in hooks:
                found = [hook(r, url or "", root) for r in found]
        except Exception as e:  # a page's failure is its own row, never its task's
            return "detail_error", [], f"{type(e).__name__}: {e}"
        empty = [r for r in found if not any(r.values())]
        if empty and len(empty) == len(found):
            return "detail_error", [], "no field was found"
        return ("ok" if found else "list_empty"), found, None


def _names(fields: AnalyzeArgument) -> list[str]:
    if not fields.isConstantExpression or not fields.value:
        raise ValueError("fields are a constant list of names with commas between")
    names = [f.strip() for f in fields.value.split(",")]
    if not all(names) or len(set(names)) < len(names):
        raise ValueError(f"names of fields differ and aren't empty: {fields.value}")
    return names


def site_records(hooks: Mapping[str, Hook] = HOOKS):
    """The class behind ``site_records(kind, spec, url, html, 'field,...')``.

    Its columns are pos, key (``url#row=pos`` for lists, the URL for details),
    a string for each field named, and error.  A page without records gives no
    row; one that fails, an unknown host or a broken declaration gives one row
    with the error and null fields.
    """

    class SiteRecords:
        @staticmethod
        def analyze(kind: AnalyzeArgument, spec: AnalyzeArgument, url: AnalyzeArgument, html: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(T.StructType([
                T.StructField("pos", T.IntegerType()), T.StructField("key", T.StringType()), *(T.StructField(f, T.StringType()) for f in _names(fields)), T.StructField("error", T.StringType()),
            ]))

        def __init__(self):
            self.reader = _Reader(hooks)

        def eval(self, kind, spec, url, html, fields):
            names = [f.strip() for f in fields.split(",")]
            _, found, error = self.reader.read(kind, spec, url, html)
            if error:
                yield (None, None, *[None] * len(names), error)
            for pos, record in enumerate(found):
                yield (pos, f"{(url or '').split('#')[0]}#row={pos}" if kind == Rows.kind else url, *(record.get(f) for f in names), None)

    return SiteRecords


def site_check(hooks: Mapping[str, Hook] = HOOKS):
    """The class behind ``site_check(TABLE(pages) PARTITION BY (host, share))``: one row a partition with counts by status.

    The table needs host, kind, spec, url and html, in any order and beside
    any others.
    """

    class SiteCheck:
        @staticmethod
        def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError("site_check takes a table")
            missing = {"host", "kind", "spec", "url", "html"} - set(pages.dataType.names)
            if missing:
                raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
            long = lambda n: T.StructField(n, T.LongType())
            return AnalyzeResult(T.StructType([T.StructField("host", pages.dataType["host"].dataType), T.StructField("kind", T.StringType()), long("pages"), long("records"), long("errors"), T.StructField("worst", T.StringType())]))

        def __init__(self):
            self.reader, self.host, self.kind, self.pages, self.records, self.errors, self.seen = _Reader(hooks), None, None, 0, 0, 0, set()

        def eval(self, row):
            status, found, error = self.reader.read(row["kind"], row["spec"], row["url"], row["html"])
            self.host, self.kind = row["host"], row["kind"]
            self.pages, self.records, self.errors = self.pages + 1, self.records + len(found), self.errors + (error is not None)
            self.seen.add(status)

        def terminate(self):
            if self.pages:
                yield self.host, self.kind, self.pages, self.records, self.errors, min(self.seen, key=LADDER.index)

    return SiteCheck


#: Statuses of a site, the worst first.
LADDER = ["no_adapter", "init_error", "fetch_error", "detail_error", "list_empty", "ok"]


def register(spark: SparkSession, hooks: Mapping[str, Hook] | None = None) -> None:
    """``site_records`` and ``site_check`` for SQL, with hooks of the caller beside the known ones."""
    ready(spark)
    known = {**HOOKS, **(hooks or {})}
    spark.udtf.register("site_records", F.udtf(site_records(known)))
    spark.udtf.register("site_check", F.udtf(site_check(known)))


def registry(spark: SparkSession, strategies: Mapping[str, Strategy]) -> DataFrame:
    """(name, kind, spec), a row a strategy; a mapping holds each name once."""
    return spark.createDataFrame([(n, s.kind, s.text()) for n, s in strategies.items()], "name string, kind string, spec string")


#: Rows of the table of hosts, and of strategies, that are broadcast: some tens of megabytes.
HOSTS, STRATEGIES = 200_000, 5_000


def _small(df: DataFrame, most: int) -> DataFrame:
    """To be broadcast if it is counted to have few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def assigned(pages: DataFrame, hosts: DataFrame, strategies: DataFrame) -> DataFrame:
    """Pages with host, kind and spec: by ``hosts`` (host, name) and ``strategies`` (name, kind, spec).

    Pages of hosts that aren't listed stay, with nulls; a host that is listed
    twice takes the smallest name that has a strategy, a name that is listed
    twice the smallest strategy.  Pages aren't shuffled where both tables are
    counted to be small.
    """
    one = strategies.groupBy("name").agg(F.min(F.struct("kind", "spec")).alias("s"))
    known = hosts.join(_small(one.select("name"), STRATEGIES), "name", "left_semi").groupBy("host").agg(F.min("name").alias("name"))
    named = pages.withColumn("host", web.authority(F.col("url"))).join(_small(known, HOSTS), "host", "left")
    return named.join(_small(one, STRATEGIES), "name", "left").select(*(c for c in named.columns if c != "name"), "s.kind", "s.spec")


def extracted(pages: DataFrame, hosts: DataFrame, strategies: DataFrame, fields: Sequence[str], hooks: Mapping[str, Hook] | None = None) -> DataFrame:
    """(page_id, host, kind, pos, key, fields..., error) by the strategy of each page's host."""
    spark = pages.sparkSession
    register(spark, hooks)
    found = assigned(pages.select("page_id", "url", "html"), hosts, strategies)
    return spark.sql(f"select p.page_id, p.host, p.kind, r.* from {{found}} p, lateral site_records(p.kind, p.spec, p.url, p.html, '{','.join(fields)}') r", found=found)


#: Pages of a host that are checked by one task.
PAGES_A_TASK = 5000


def checked(pages: DataFrame, hosts: DataFrame, strategies: DataFrame, hooks: Mapping[str, Hook] | None = None) -> DataFrame:
    """(host, kind, pages, records, errors, status) of each host; the worst status of its pages is its own.

    Hosts of many pages are dealt to several tasks, whose counts add up.
    """
    spark = pages.sparkSession
    register(spark, hooks)
    found = assigned(pages.select("page_id", "url", "html"), hosts, strategies)
    many = found.groupBy("host").count().where(F.col("count") > PAGES_A_TASK).select("host", F.ceil(F.col("count") / PAGES_A_TASK).alias("shares"))
    dealt = found.join(many, "host", "left").withColumn("share", F.pmod(F.xxhash64("page_id"), F.coalesce("shares", F.lit(1)))).drop("shares", "page_id")
    parts = spark.sql("select * from site_check(table({dealt}) partition by (host, share))", dealt=dealt)
    rank = F.array_position(F.lit(LADDER), F.col("worst"))
    return parts.groupBy("host", "kind").agg(F.sum("pages").alias("pages"), F.sum("records").alias("records"), F.sum("errors").alias("errors"), F.min_by("worst", rank).alias("status"))
