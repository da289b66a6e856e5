"""Personal data: fixed formats, and identifiers found by bootstrapped contextual patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescope.llm.common import text_of
from ratescope.runtime import settle

#: The kinds in order, with their formats. Written without back-tracking (possessive), and
#: started only where a run of their characters starts or the last match ended, so that long runs
#: take linear time; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Parts of at most 255, whatever their leading zeros.
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: A word that could be an identifier: it has four digits or more, or an @.
CANDIDATE = r"(?<![^\s])(?:(?=\S*@)|(?=(?:[^\s0-9]*+[0-9]){4}))\S++"
#: Groups of digits joined by blanks, dots, hyphens and brackets: the base formats without their checks. At least one of each is joined.
GROUPED = r"(?<![^\s])[(+]?+[0-9]++(?:(?:\x20?\(|\)[\x20.-]?+|[\x20.-])[0-9]++)++"
#: The digits of a run of groups, together.
FEWEST, MOST = 7, 19
SPAN = "array<struct<start:int,end:int,text:string,before:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum is a multiple of 10, every second from the right doubled."""
    last = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = (last - i) % 2 == 1
        return F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), last), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def located(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` with their places in code points, and up to 60 characters of the text before each.

    The text between matches is what splitting by the pattern leaves; lengths add up to places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.zip_with(gaps, found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        before = F.right(F.concat(state["tail"], part["gap"]), F.lit(60))
        span = F.struct(start.alias("start"), end.alias("end"), part["match"].alias("text"), before.alias("before"))
        tail = F.right(F.concat(before, part["match"]), F.lit(60))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(state["out"], F.array(span)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(SPAN).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(parts, start, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, kind: str) -> Column:
    """The matches of a fixed format that pass its check; failing ones are dropped without another try."""
    has_digit = text.rlike("[0-9]")
    maybe, pattern, good = {
        "email": (F.contains(text, F.lit("@")), EMAIL, None),
        "ip": (has_digit & text.rlike(r"[0-9]\.[0-9]"), IP, lambda s: s["text"].rlike(IP_PARTS)),
        "card": (
            has_digit & text.rlike(r"(?:[0-9][\x20-]?+){12}[0-9]"),
            CARD,
            lambda s: F.when(F.length(_digits(s["text"])).between(13, 19), _luhn(_digits(s["text"]))).otherwise(False),
        ),
        "phone": (F.contains(text, F.lit("+")), PHONE, lambda s: F.length(_digits(s["text"])).between(9, 15)),
    }[kind]
    found = F.when(maybe, located(text, pattern)).otherwise(F.array().cast(SPAN))
    return F.filter(found, good) if good else found


def _context(before: Column) -> Column:
    """The two words before a span, lower case, digits as 0: the lexical pattern. Null where there are none."""
    words = F.regexp_extract(F.lower(F.regexp_replace(before, "[0-9]+", "0")), r"(\S+\s+\S+|\S+)\s*$", 1)
    return F.nullif(F.regexp_replace(words, r"\s+", " "), F.lit(""))


def _graph_scores(edges: DataFrame, rounds: int, least_seeds: int, sure: float) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and of instances, by turns.

    ``edges`` has (context, instance, kind), kind null for instances that no format covers. A
    pattern's score for a kind is the sum of its distinct instances' scores for it, over their number and one. An instance of a format scores 1;
    another one 1 - product(1 - score) over the patterns that score ``sure`` or more and have ``least_seeds`` instances
    known to be of the kind. Both are aggregates and joins over the edges, settled every round.
    """
    seeds = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    size = edges.groupBy("context").agg(F.countDistinct("instance").alias("n"))
    known, patterns = seeds, None
    for _ in range(rounds):
        told = edges.select("context", "instance").distinct().join(known, "instance")
        patterns = settle(
            told.groupBy("context", "kind")
            .agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("support"))
            .where(F.col("support") >= least_seeds)
            .join(size, "context")
            .withColumn("confidence", F.col("sum") / (F.col("n") + 1))
            .where(F.col("confidence") >= sure)
            .select("context", "kind", "confidence")
        )
        fresh = edges.where("kind is null").select("context", "instance").distinct().join(patterns, "context")
        fresh = fresh.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        known = settle(seeds.union(fresh.where(F.col("score") >= sure)))
    return patterns, known


def personal_data(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rounds: int = 3,
    least_seeds: int = 5,
    sure: float = 0.6,
) -> DataFrame:
    """Personal data of every row: spans of the four fixed formats and those that context reveals.

    The spans of the formats are seeds. The two words before a span are a lexical pattern; runs of digit groups
    (``FEWEST`` to ``MOST`` digits, joined by blanks, dots, hyphens or brackets) and, outside of them, words with four digits or an
    @ which no format covers are candidates with patterns of their own. Patterns and instances (span
    texts) make a graph that is scored for some rounds over the whole corpus (see ``_graph_scores``);
    a candidate that scores ``sure`` in one of the sure patterns is a span of the pattern's kind. So
    a card number with a wrong digit, or a phone number without its plus, is found where texts write such numbers in the same way.

    Returns id, the number of base spans of each kind, base_sha256 over them, spans (base and found ones), and n_found.
    A null text counts as empty, with no spans; rows with equal ids are told apart. Only built-in expressions run.
    """
    text = F.col("text")
    read = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), F.monotonically_increasing_id().alias("row"))
    spans = [base_spans(text, kind).alias(kind) for kind in KINDS]
    some = text.rlike(r"@|[0-9](?:[^\s0-9]*+[0-9]){3}")
    candidates = F.when(some, located(text, CANDIDATE)).otherwise(F.array().cast(SPAN)).alias("candidates")
    some_groups = text.rlike(r"[0-9][\x20().-]{1,2}[0-9]")
    runs = F.filter(located(text, GROUPED), lambda c: F.length(_digits(c["text"])).between(FEWEST, MOST))
    groups = F.when(some_groups, runs).otherwise(F.array().cast(SPAN)).alias("groups")
    found = settle(read.select("id", "row", *spans, candidates, groups))

    seeds = reduce(
        DataFrame.union,
        [found.select(F.explode(kind).alias("s")).select(_context(F.col("s.before")).alias("context"), F.col("s.text").alias("instance"), F.lit(kind).alias("kind")) for kind in KINDS],
    )
    every = F.concat(*KINDS)

    def free(spans: Column | str, taken: Column | str) -> Column:
        return F.filter(spans, lambda c: ~F.exists(taken, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))

    loose = settle(
        found.where((F.size("candidates") > 0) | (F.size("groups") > 0))
        .withColumn("groups", free("groups", every))
        .select("row", F.explode(F.concat("groups", free(free("candidates", every), "groups"))).alias("c"))
        .select("row", "c.start", "c.end", _context(F.col("c.before")).alias("context"), F.col("c.text").alias("instance"))
        .where("context is not null")
    )
    edges = seeds.where("context is not null").union(loose.select("context", "instance", F.lit(None).cast("string"))).distinct()
    patterns, known = _graph_scores(settle(edges), rounds, least_seeds, sure)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    revealed = (
        loose.join(patterns, "context")
        .join(known.select("instance", "kind", "score"), ["instance", "kind"])
        .select("row", F.struct(place.alias("place"), "start", "end").alias("span"))
        .groupBy("row")
        .agg(F.collect_set("span").alias("revealed"))
    )
    no_spans = F.array().cast("array<struct<place:int,start:int,end:int>>")

    def placed(place: int) -> Column:
        named = lambda s: F.struct(F.lit(place).alias("place"), s["start"].alias("start"), s["end"].alias("end"))
        return F.transform(KINDS[place - 1], named)

    base = F.concat(*[placed(place) for place in range(1, len(KINDS) + 1)])
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.join(revealed, "row", "left").withColumn("revealed", F.coalesce("revealed", no_spans)).select(
        F.col("id").alias(id_column),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(base, F.col("revealed")))).alias("spans"),
        F.size("revealed").cast("long").alias("n_found"),
    )
