"""Secret scanning with multipart credential linking, in DataFrame functions only.

Strong patterns (``assign``, ``access``, ``hex``) are reported wherever they match. Weak ones are parts of credentials
that mean little alone: login names, bare 40-character keys, endpoints. They are joined as intervals with their
complementary parts: only where these lie within the same scope, at most ``reach`` code points away, is the weak part
reported. A key needs an access identifier (``access`` or ``login``), a login needs a secret (``assign``, ``hex`` or
``key``), an endpoint needs both.

The join sorts all spans of a document by start and scans them once in each direction: of the complements that start
earlier only the greatest stop matters, of those that start later only the first start.

Matches are placed by marking them in the text and splitting at the marks: the lengths of the parts add up to the
places. Everything happens within the row, so nothing is shuffled and no row depends on another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tristrata.llm.common import text_or_empty

#: Strong patterns of the contract, in its order.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Weak parts of credentials.
LOGIN = r"((?i:login|user_?name|account|client_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.-]+)"
KEY = r"[A-Za-z0-9/+=]+"
ENDPOINT = r"https?://[A-Za-z0-9.:/_-]+"

#: Order of kinds among spans of equal starts.
KINDS = ("assign", "access", "hex", "login", "key", "endpoint")
MARK = "\x01"
#: Elements per slice of a scan.
SLICE = 128
#: Further than any place.
FAR = 1 << 40
SPAN = "struct<start:int,order:int,stop:int>"
IDENTIFIERS = ("access", "login")
SECRETS = ("assign", "hex", "key")


def _marked(pattern: str, needle: str | None = None) -> Column:
    """Alternating parts of ``text``: outside a match, a match, outside, … Matches contain the ``needle``."""
    text = F.col("text")
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return parts if needle is None else F.when(F.contains(text, F.lit(needle)), parts).otherwise(F.array(text))


def _scan(elements: Column, first: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], out_type: str) -> Column:
    """``out(state, element)`` for all elements, the state being what ``step`` made of the elements before.

    A fold copies its whole state at each element, so it must not hold an array that grows: one fold finds the states at
    which slices begin, and each slice then gives its own results.
    """
    none = F.expr(f"cast(array() as array<{out_type}>)")

    def carry(acc: Column, slice_: Column) -> Column:
        return F.struct(
            F.aggregate(slice_, acc["state"], step).alias("state"), F.concat(acc["begins"], F.array(acc["state"])).alias("begins"))

    def results(slice_: Column, begin: Column) -> Column:
        return F.aggregate(
            slice_, F.struct(begin.alias("state"), none.alias("done")),
            lambda acc, element: F.struct(
                step(acc["state"], element).alias("state"), F.concat(acc["done"], F.array(out(acc["state"], element))).alias("done")),
            lambda acc: acc["done"])

    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(elements) - 1) / SLICE).cast("int")), lambda i: F.slice(elements, i * SLICE + 1, SLICE))
    begins = F.aggregate(
        slices, F.struct(first.alias("state"), F.filter(F.array(first), lambda _: F.lit(False)).alias("begins")), carry, lambda acc: acc["begins"])
    return F.when(F.size(elements) > 0, F.flatten(F.zip_with(slices, begins, results))).otherwise(none)


def _spans(parts: Column, kind: str, keep) -> Column:
    """Structs ``(start, order, stop)`` of the matches among ``parts`` that ``keep`` accepts."""
    def step(state: Column, part: Column) -> Column:
        return F.struct((state["at"] + F.length(part)).cast("int").alias("at"), (~state["inside"]).alias("inside"))

    def span(state: Column, part: Column) -> Column:
        stop = (state["at"] + F.length(part)).cast("int")
        return F.when(state["inside"] & keep(part), F.struct(state["at"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), stop.alias("stop")))

    found = _scan(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside")), step, span, SPAN)
    return F.when(F.size(parts) > 1, F.filter(found, lambda s: s.isNotNull())).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _is(span: Column, kinds: tuple[str, ...]) -> Column:
    return span["order"].isin([KINDS.index(k) for k in kinds])


def _distances(spans: Column, ahead: bool) -> Column:
    """For each of the spans, sorted by start, how far the nearest identifier and secret before it are.

    ``ahead``: of the spans in reverse, how far those after it are.
    A span reaches to the greatest stop of those before it and to the first start of those after it.
    """
    def step(state: Column, span: Column) -> Column:
        def best(name: str, kinds: tuple[str, ...]) -> Column:
            place = span["start"].cast("long") if ahead else F.greatest(state[name], span["stop"].cast("long"))
            return F.when(_is(span, kinds), place).otherwise(state[name]).alias(name)
        return F.struct(best("identifier", IDENTIFIERS), best("secret", SECRETS))

    def out(state: Column, span: Column) -> Column:
        def gap(name: str) -> Column:
            return (state[name] - span["stop"] if ahead else span["start"] - state[name]).alias(name)
        return F.struct(gap("identifier"), gap("secret"))

    nothing = F.lit(FAR if ahead else -FAR).cast("long")
    return _scan(
        spans, F.struct(nothing.alias("identifier"), nothing.alias("secret")),
        step, out, "struct<identifier:bigint,secret:bigint>")


def _linked(spans: Column, before: Column, after: Column, reach: int) -> Column:
    """The weak ones of sorted spans whose complements lie at most ``reach`` code points away."""
    def near(row: Column, name: str) -> Column:
        return F.least(row["before"][name], row["after"][name]) <= reach

    rows = F.filter(F.arrays_zip(spans.alias("span"), before.alias("before"), after.alias("after")), lambda row: (
        (_is(row["span"], ("login",)) & near(row, "secret")) | (_is(row["span"], ("key",)) & near(row, "identifier"))
        | (_is(row["span"], ("endpoint",)) & near(row, "identifier") & near(row, "secret"))))
    return F.transform(rows, lambda row: row["span"])


def _joined(spans: Column) -> Column:
    """``kind:start:stop`` of all spans in order of start, then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans``.

    Spans are ``kind:start:stop`` in code points, the stop exclusive, ordered by start and kind, joined by commas.
    ``base_sha256`` is the hash of those of the strong patterns, ``spans`` has the linked weak ones, too.

    Null and empty texts have no spans. Null or repeated ids stay as they are, one row each. Empty tables give empty
    results. Other columns of ``docs`` are ignored. Time is linear in the text and in its matches, which are sorted.
    """
    # The mark is replaced in the text by another control character, which no pattern matches either.
    text = F.translate(text_or_empty(text_column), MARK, "\x02")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    # A run of one class of characters is matched whole, so its least length can be part of the pattern; a failing
    # match of the two patterns with keywords may hide later ones, so those are matched first and then judged.
    rows = rows.select(
        "doc_id", _marked(ASSIGN).alias("assign"), _marked(ACCESS, "AKIA").alias("access"),
        _marked(HEX.replace("]+", "]{24,}")).alias("hex"), _marked(LOGIN).alias("login"),
        _marked(KEY.replace("]+", "]{40,}")).alias("key"), _marked(ENDPOINT, "://").alias("endpoint"))
    rows = rows.select(
        "doc_id",
        _spans(F.col("assign"), "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("assign"),
        _spans(F.col("access"), "access", lambda m: F.length(m) >= 20).alias("access"),
        _spans(F.col("hex"), "hex", lambda m: F.lit(True)).alias("hex"),
        _spans(F.col("login"), "login", lambda m: F.length(F.regexp_extract(m, LOGIN, 2)) >= 3).alias("login"),
        _spans(F.col("key"), "key", lambda m: F.length(m) == 40).alias("key"),
        _spans(F.col("endpoint"), "endpoint", lambda m: F.lit(True)).alias("endpoint"))
    weak = F.concat("login", "key", "endpoint")
    base = F.concat("assign", "access", "hex")
    rows = rows.select("doc_id", "assign", "access", "hex", base.alias("base"), F.when(F.size(weak) > 0, F.array_sort(F.concat(base, weak)))
                       .otherwise(F.expr(f"cast(array() as array<{SPAN}>)")).alias("span"))
    rows = rows.select("*", F.reverse("span").alias("backwards"))
    rows = rows.select("*", _distances(F.col("span"), False).alias("before"), _distances(F.col("backwards"), True).alias("after"))
    rows = rows.select("*", _linked(F.col("span"), F.col("before"), F.reverse("after"), reach).alias("linked"))
    return rows.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "linked")),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "linked")).alias("spans"))
