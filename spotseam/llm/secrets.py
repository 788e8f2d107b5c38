r"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong spans are found by pattern alone.  Weak candidates, a bare mixed string or
an endpoint address, mean nothing by themselves; they are reported only where the
parts that complete a credential lie within their scope: an access identifier for
a bare string, an access identifier and a secret for an endpoint.  Scopes are joined
as intervals on buckets of positions; each bucket has one row a document, with its
first and last position, so the join has at most three rows a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, need

#: The kinds and their patterns, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "bare", "endpoint")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 16 and more: the same spans as all runs with the shorter ones dropped.
HEX = r"[0-9a-f]{16,}"
BARE = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}"""
#: Code points between the starts of parts of one credential.
SCOPE = 400

#: Matches whose spans are added up in one go: a list grows by copying, so a text's are not gathered in one.
STEP = 256

_SPANS = "array<struct<s:bigint,k:int,e:bigint>>"


def spans_of(text: Column, pattern: str, kind: int, keep) -> Column:
    """Leftmost non-overlapping matches as (s, k, e) in code points, those that ``keep(match)`` allows.

    What lies between matches comes from splitting at the same pattern; adding up
    the lengths of both gives positions without any Python.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")).alias("g"), F.transform(found, lambda m: F.struct(F.length(m).cast("long").alias("n"), keep(m).alias("ok"))).alias("m"))
    zero, none = F.lit(0).cast("long"), F.array().cast(_SPANS)
    length = lambda x: x["g"] + F.coalesce(x["m"]["n"], zero)

    def add(acc: Column, x: Column) -> Column:
        s, e = acc["at"] + x["g"], acc["at"] + length(x)
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(F.coalesce(x["m"]["ok"], F.lit(False)), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def blocks(x: Column) -> Column:
        """The pairs in blocks, and where each block begins."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda i: F.slice(x, i * STEP + 1, F.lit(STEP)))
        sizes = F.transform(parts, lambda part: F.aggregate(part, zero, lambda acc, y: acc + length(y)))
        first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        begins = F.aggregate(sizes, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.struct(parts.alias("parts"), begins.alias("begins"))

    def spans(x: Column) -> Column:
        of = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])
        return F.flatten(F.zip_with(x["parts"], x["begins"], of))

    return F.when(F.exists(found, keep), _let(_let(pairs, blocks), spans)).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _near(left: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """Rows of ``left`` with one of ``parts`` within the scope: an interval join on buckets."""
    ends = parts.groupBy("doc_id", "th", "b").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    ends = ends.select("doc_id", "th", "lo", "hi", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    a, p = left.alias("a"), ends.alias("p")
    on = F.col("a.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("a.th") == F.col("p.th")) & (F.col("a.b") == F.col("p.b"))
    return a.join(p, on & (F.col("p.lo") <= F.col("a.s") + scope) & (F.col("p.hi") >= F.col("a.s") - scope), "left_semi")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, base (spans found by pattern) and linked (weak ones that a credential completes).

    Spans are (s, k, e): start and end in code points, end exclusive, and the kind's
    place in KINDS.  Null and empty texts have none.  Rows that repeat an id and a text
    get the same spans each; other columns of ``docs`` are left out.  A bare string needs
    an upper-case letter, a lower-case one and a digit, and lies outside strong spans.
    """
    need(docs, id_col, text_col)
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    assign = spans_of(F.col("t"), ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12)
    access = spans_of(F.col("t"), ACCESS, 1, lambda m: F.length(m) >= 18)
    hexes = spans_of(F.col("t"), HEX, 2, lambda m: F.length(m) >= 16)
    base = t.select("doc_id", "t", assign.alias("a"), access.alias("c"), hexes.alias("h"))
    base = base.select("doc_id", "t", F.concat("a", "c", "h").alias("base"), (F.size("c") > 0).alias("anchored"))
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    none = F.array().cast(_SPANS)
    weak = F.when(F.col("anchored"), F.concat(spans_of(F.col("t"), BARE, 3, mixed), spans_of(F.col("t"), ENDPOINT, 4, lambda m: F.lit(True)))).otherwise(none)
    rows = cut(base.select("doc_id", "base", F.when(F.col("anchored"), F.sha2("t", 256)).alias("th"), weak.alias("weak")), "secret-spans")

    held = rows.filter("th is not null")
    one = lambda c: held.select("doc_id", "th", F.explode(c).alias("x")).select("doc_id", "th", "x.*", F.floor(F.col("x.s") / scope).alias("b"))
    outside = F.filter("weak", lambda w: (w["k"] == 4) | ~F.exists("base", lambda s: (s["s"] < w["e"]) & (w["s"] < s["e"])))
    strong, loose = one("base"), one(outside)
    ids = strong.filter("k = 1")
    bare = _near(loose.filter("k = 3"), ids, scope)
    secrets = strong.filter("k <> 1").unionByName(bare)
    ends = _near(_near(loose.filter("k = 4"), ids, scope), secrets, scope)
    linked = bare.unionByName(ends).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "k", "e")).alias("linked"))
    r, x = rows.alias("r"), linked.alias("x")
    on = F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.th") == F.col("x.th"))
    return r.join(x, on, "left").select("r.doc_id", "r.base", F.coalesce("x.linked", none).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and canonical texts of the spans."""
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.concat("base", "linked")).alias("spans"))
