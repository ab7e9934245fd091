"""Secret scan: known forms by pattern, and random strings by a battery of tests. Column functions only.

A candidate of the battery is a maximal run of 20 or more token characters whose characters fit an encoding:
hexadecimal, base 32, base 62 or base 64. Its null hypothesis is that it is random text of that encoding.
Three tests are combined by Fisher's method: chi-squared for a uniform alphabet, runs above and below the
middle of the alphabet, and serial correlation of neighbours. Within each band of lengths, where tests have
like power, the Benjamini-Hochberg rule rejects strings as not random at a false-discovery rate ``RATE``:
at most that share of those set aside are truly random. What is not rejected is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stopwise.llm.common import staged

# The known forms.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
RATE = 0.05
GRID = 100  # steps of a p-value's logarithm per factor of e; rounded up, so that counts per step are all the rule needs
LEAST_LOG = -690  # smaller ones, below about 1e-300, are one step

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 256  # elements of an array that a fold grows at once
_SPAN = "array<struct<start:int,end:int,text:string>>"
_GAP = "array<struct<start:int,end:int>>"


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(array: Column) -> Column:
    """The array in pieces of ``BLOCK`` elements."""
    count = F.ceil(F.size(array) / BLOCK).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.transform(numbers, lambda k: F.slice(array, k * BLOCK + 1, F.lit(BLOCK)))


def running(array: Column, kind: str, step) -> Column:
    """What ``step(carry, element)`` gives of every element, in order: a struct of the next carry and an array to keep.

    The carry is a number and starts at 0. Results grow within blocks and blocks are put together at the end:
    growing one array by each element would copy it as often as it has elements.
    """
    empty = lambda kind: F.expr(f"CAST(array() AS {kind})")

    def within(carry: Column, block: Column) -> Column:
        def one(s: Column, x: Column) -> Column:
            return _bound(step(s["carry"], x), lambda r: F.struct(r["carry"].alias("carry"), F.concat(s["kept"], r["kept"]).alias("kept")))

        return F.aggregate(block, F.struct(carry.alias("carry"), empty(kind).alias("kept")), one)

    def across(s: Column, block: Column) -> Column:
        put = lambda r: F.struct(r["carry"].alias("carry"), F.concat(s["kept"], F.array(r["kept"])).alias("kept"))
        return _bound(within(s["carry"], block), put)

    start = F.struct(F.lit(0).alias("carry"), empty(f"array<{kind}>").alias("kept"))
    return _bound(array, lambda a: F.aggregate(_blocks(a), start, across, lambda s: F.flatten(s["kept"])))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``start, end, text`` in code points.

    The text between matches and the matches themselves, in turn, add up to the places.
    """
    between, matched = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(at: Column, pair: Column) -> Column:
        first = at + F.length(pair["b"])
        last = first + F.length(pair["m"])
        one = F.struct(first.alias("start"), last.alias("end"), pair["m"].alias("text"))
        return F.struct(last.alias("carry"), F.array(one).alias("kept"))

    pairs = F.zip_with(F.slice(between, 1, F.size(matched)), matched, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    return F.when(text.rlike(pattern), running(pairs, _SPAN, step)).otherwise(F.expr(f"CAST(array() AS {_SPAN})"))


def upper_tail(z: Column) -> Column:
    """``P(N > z)`` of a standard normal, by the rational approximation of the error function."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = series * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def alphabet(text: Column) -> Column:
    """The characters of the encoding that the string seems to have, in order; null for none."""
    mixed = text.rlike("[a-z]") & text.rlike("[A-Z]") & text.rlike("[0-9]")
    return (
        F.when(text.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"), F.lit(_DIGITS + _LOWER[:6]))
        .when(text.rlike("^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"), F.lit(_DIGITS + _UPPER[:6]))
        .when(text.rlike("^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"), F.lit(_UPPER + "234567"))
        .when(mixed & text.rlike("^[A-Za-z0-9]+$"), F.lit(_UPPER + _LOWER + _DIGITS))
        .when(mixed & text.rlike("^[A-Za-z0-9+/]+$"), F.lit(_UPPER + _LOWER + _DIGITS + "+/"))
        .when(mixed & text.rlike("^[A-Za-z0-9_-]+$"), F.lit(_UPPER + _LOWER + _DIGITS + "-_"))
    )


def battery(text: Column, letters: Column) -> Column:
    """Combined p-value of the three tests, 0 to 1; small means not random."""
    places = F.transform(F.split(text, ""), lambda c: F.instr(letters, c).cast("double"))
    places = F.filter(places, lambda p: p > 0)
    n, size = F.length(text).cast("double"), F.length(letters).cast("double")
    count = lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double")
    squares = F.aggregate(F.sequence(F.lit(1), F.length(letters)), F.lit(0.0), lambda a, k: a + F.pow(count(k), 2.0))
    freedom = size - 1
    chi = size / n * squares - n
    z_chi = (F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    # sums over neighbours in one pass: runs, products, values, squares, values above the middle
    middle = (size + 1) / 2
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("last", "first", "runs", "above", "cross", "sum", "square")])

    def step(s: Column, p: Column) -> Column:
        change = (s["last"] == 0) | ((p > middle) != (s["last"] > middle))
        return F.struct(
            p.alias("last"),
            F.when(s["last"] == 0, p).otherwise(s["first"]).alias("first"),
            (s["runs"] + change.cast("double")).alias("runs"),
            (s["above"] + (p > middle).cast("double")).alias("above"),
            (s["cross"] + s["last"] * p).alias("cross"),
            (s["sum"] + p).alias("sum"),
            (s["square"] + p * p).alias("square"),
        )

    def finish(s: Column) -> Column:
        n1, n2 = s["above"], n - s["above"]
        expected = 2 * n1 * n2 / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(spread > 0, (s["runs"] - expected) / F.sqrt(spread)).otherwise(F.sqrt(n))
        mean = s["sum"] / n
        variance = s["square"] - n * mean * mean
        covariance = s["cross"] - mean * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * mean * mean
        z_serial = F.when(variance > 0, covariance / variance * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(F.sqrt(n))
        tails = [upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial))]
        total = sum((-F.log(F.greatest(p, F.lit(1e-300))) for p in tails), F.lit(0.0))
        return F.exp(-total) * (1 + total + total * total / 2)  # Fisher: chi-squared with 6 degrees of freedom

    return F.least(F.aggregate(places, zero, step, finish), F.lit(1.0))


def _marked(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (spans of known forms with the place of their kind) and ``_tested`` (candidates)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long_enough = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 8)
    kinds = [long_enough, spans(text, ACCESS), spans(text, HEX)]
    marked = [_marked(found, k) for k, found in enumerate(kinds)]
    wide = docs.withColumn("_base", F.array_sort(F.concat(*marked)))
    coded = F.transform(
        spans(text, CANDIDATE),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), alphabet(s["text"]).alias("letters")),
    )
    coded = F.filter(coded, lambda s: s["letters"].isNotNull())
    wide = wide.withColumn("_coded", coded)
    outside = F.filter(
        "_coded", lambda s: ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    )
    tested = F.transform(
        outside,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.floor(F.log2(s["end"] - s["start"])).cast("int").alias("band"),
            stepped(battery(s["text"], s["letters"])).alias("step"),
        ),
    )
    return wide.withColumn("_tested", tested).drop("_coded")


def stepped(p: Column) -> Column:
    """The step of a p-value: 0 for 1, and ``-GRID`` for every factor of e below it."""
    log = F.coalesce(F.log(p), F.lit(float(LEAST_LOG)))
    return F.ceil(F.greatest(log, F.lit(float(LEAST_LOG))) * GRID).cast("int")


def thresholds(tested: DataFrame, rate: float) -> dict[int, int]:
    """Per band of lengths (at most 31 of them) the largest step of p-values that is rejected."""
    each = tested.select(F.explode("_tested").alias("t")).groupBy("t.band", "t.step").agg(F.count("*").alias("n"))
    band = Window.partitionBy("band")
    upto = F.sum("n").over(band.orderBy("step"))
    ruled = each.withColumns({"upto": upto, "all": F.sum("n").over(band)})
    fits = ruled.filter(F.exp(F.col("step") / GRID) * F.col("all") <= rate * F.col("upto"))
    return {r["band"]: r["step"] for r in fits.groupBy("band").agg(F.max("step").alias("step")).collect()}


def scan_secrets(docs: DataFrame, rate: float = RATE, column: str = "secrets") -> DataFrame:
    """Rows and columns of ``docs``, with ``column``: ``start, kind, end`` by start, then kind; places in code points.

    Kinds are numbers of :data:`KINDS`. A random string inside a span of a known form is not given again.
    A null or empty text has none; texts are read whole; rows that repeat give the same spans. A column
    of that name (or of the working columns, ``_base``, ``_coded`` and ``_tested``) is replaced.
    """
    seen = staged(scanned(docs.drop(column, "_base", "_coded", "_tested")), "scanned")
    limits = thresholds(seen, rate)
    held = F.filter("_tested", lambda t: t["step"] > _limit(t["band"], limits))
    added = _marked(held, KINDS.index("random"))
    return seen.withColumn(column, F.array_sort(F.concat("_base", added))).drop("_base", "_tested")


def _limit(band: Column, limits: dict[int, int]) -> Column:
    out = F.lit(GRID * LEAST_LOG - 1)
    for k, step in limits.items():
        out = F.when(band == k, F.lit(step)).otherwise(out)
    return out


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or union of spans that overlap, replaced by ``mark``.

    What stays is cut out of the stretch of text that a block of gaps lies in, so that no cut counts
    characters from the beginning of a long text.
    """
    gap = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    def step(at: Column, x: Column) -> Column:
        kept = F.filter(F.array(gap(at, x["start"])), lambda g: g["end"] >= g["start"])
        # a span that begins inside the one before has no gap; one that touches it is a mark of its own
        return F.struct(F.greatest(at, x["end"]).alias("carry"), kept.alias("kept"))

    tail = F.array(gap(F.array_max(F.transform(found, lambda x: x["end"])), F.length(text)))
    gaps = F.concat(running(found, _GAP, step), tail)

    def cut(block: Column) -> Column:
        first, last = F.element_at(block, 1)["start"], F.element_at(block, -1)["end"]
        part = F.struct(first.alias("at"), F.substring(text, first + 1, last - first).alias("text"))
        pieces = lambda p: F.transform(block, lambda g: F.substring(p["text"], g["start"] - p["at"] + 1, g["end"] - g["start"]))
        return F.array_join(_bound(part, pieces), mark)

    masked = _bound(gaps, lambda g: F.array_join(F.transform(_blocks(g), cut), mark))
    return F.when(F.size(found) > 0, masked).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    name = lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", name), ",").alias("spans"),
    )
