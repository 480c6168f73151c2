"""Secret scans with character Markov models, in DataFrame functions only (operator 10).

The base kinds are what fixed patterns match from left to right without overlap. Spark's pattern functions
return texts, not places: each match is therefore taken with all that lies between it and the one before
(the match begins where the last ended, so a text is read once), and running sums of lengths are the places.

Further strings are judged by Markov chains over characters: three of random strings, one for the values of each
base kind, besides the chain in which all letters and digits are as likely; and one of ordinary strings. A string is
reported where the log-likelihood ratio of its best random chain to the ordinary one passes a threshold and no base
span overlaps it. The samples are labelled by the base patterns: what they match in any row is random, all other
strings of any row are ordinary.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = "password|passwd|secret|token|api_?key"
_ASSIGN = rf"""(?i:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"(AKIA[A-Z0-9]{16,})"
_HEX = r"([0-9a-f]{24,})"
#: strings that the chains judge, and those that count as ordinary where no base span covers them
_JUDGED = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{10,}+={0,2})"
_ORDINARY = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{6,}+={0,2})"
#: in the order in which spans of one start are listed; the shortest value that counts
BASE = {"assign": (_ASSIGN, 6), "access": (_ACCESS, 20), "hex": (_HEX, 24)}

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=."
#: log of how many ordinary strings there are to a random one, at least: a ratio below it is no evidence
THRESHOLD = 14.0
#: values of base kinds from this length on are samples of random strings
SAMPLE_LENGTH = 16
#: words are also spelled in capitals and joined to names, each by so many of its occurrences
CAPITALS = JOINED = 0.01
JOINTS = "_-/"
#: states are places in ASCII from "+" to "z", 0 is the begin of a string and any other character
_FIRST, _LAST = ord(min(ALPHABET)), ord(max(ALPHABET))
_STATES = _LAST - _FIRST + 2
_CHUNK = 64
_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def _running(steps: Column, begin: Column) -> Column:
    """Start and end of every step, which is what lies before a match (p), the match (m) and its value (v)."""
    zero = F.struct(begin.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["p"]
        span = F.struct(start.alias("start"), (start + s["m"]).alias("end"), s["v"].alias("value"))
        return F.struct((start + s["m"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, zero, add, lambda acc: acc["out"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str, whole: bool = False) -> Column:
    """All matches of a pattern with one group: start and end of the match in code points, and the group's text.

    Running sums are made in chunks, so that a text with many matches costs little more than their number.
    ``whole`` tells that the group is the whole match.
    """
    chained = F.lit(rf"\G(?s:(.*?))((?:{pattern}))")
    before, match, value = (F.regexp_extract_all(text, chained, F.lit(i)) for i in (1, 2, 3))
    if whole:
        steps = F.zip_with(before, match, lambda p, m: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m"), m.alias("v")))
    else:
        sizes = F.zip_with(before, match, lambda p, m: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m")))
        steps = F.zip_with(sizes, value, lambda s, v: F.struct(s["p"].alias("p"), s["m"].alias("m"), v.alias("v")))

    def chunks(steps: Column) -> Column:
        many = F.ceil(F.size(steps) / F.lit(_CHUNK)).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.slice(steps, k * _CHUNK + 1, F.lit(_CHUNK)))

    def spans(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["p"] + s["m"]))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        begins = F.aggregate(
            totals, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
        )
        return F.flatten(F.zip_with(chunks, begins, _running))

    found = _let(_let(steps, chunks), spans)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def _labelled(found: Column, rank: int, kind: str) -> Column:
    return F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    ).cast(_SPANS)


def _no_shorter(least: int):
    return lambda s: F.length(s["value"]) >= least


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start and kind."""
    parts = []
    for rank, (kind, (pattern, least)) in enumerate(BASE.items()):
        parts.append(_labelled(F.filter(_matches(text, pattern, whole=kind != "assign"), _no_shorter(least)), rank, kind))
    return F.array_sort(F.concat(*parts))


def _state(character: Column) -> Column:
    code = F.ascii(character)
    return F.when(code.between(_FIRST, _LAST), code - (_FIRST - 1)).otherwise(0)


def _place(character: str) -> int:
    return ord(character) - _FIRST + 1


def _transitions(strings: DataFrame, by: str) -> dict[int, dict[tuple[int, int], int]]:
    """Counts of character pairs in the column ``s``, each string ``n`` times, by the number ``by``; state 0 before the first.

    As many rows as values of ``by`` and pairs of states.
    """
    chars = strings.select(by, "n", F.split("s", "").alias("c")).select(by, "n", "c", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("i"))
    before = F.when(F.col("i") == 1, 0).otherwise(_state(F.get("c", F.col("i") - 2)))
    pairs = chars.where("c[i - 1] <> ''").select(by, "n", before.alias("a"), _state(F.element_at("c", F.col("i"))).alias("b"))
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in pairs.groupBy(by, "a", "b").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r[by], {})[r["a"], r["b"]] = r["n"]
    return out


def _log_chain(counts: Mapping[tuple[int, int], float]) -> list[float]:
    """Logarithms of the share of every pair among those of its first state, each seen once more than counted."""
    rows = [len(ALPHABET) + 1.0] * _STATES
    for (a, _), n in counts.items():
        rows[a] += n
    return [math.log((counts.get((a, b), 0) + 1) / rows[a]) for a in range(_STATES) for b in range(_STATES)]


def _with_names(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """Counts of ordinary strings and of the names made of them: MAX_SIZE, max-size, maxSize, which a corpus may lack.

    Each pair of small letters, or of one and what is no letter, also counts ``CAPITALS`` for the same pair in
    capitals. After each letter or digit, ``JOINED`` of the strings go on with each joint or with the capital of a
    first letter; after a joint, they go on as strings begin.
    """
    capital = {_place(c): _place(c.upper()) for c in ALPHABET if c.islower()}
    capitals = set(capital.values())
    joints = [_place(c) for c in JOINTS]
    out: dict[tuple[int, int], float] = dict(counts)

    def add(a: int, b: int, n: float) -> None:
        out[a, b] = out.get((a, b), 0) + n

    passed, begun = dict.fromkeys(range(_STATES), 0), {}
    for (a, b), n in counts.items():
        passed[a] += n
        if a == 0:
            begun[b] = n
        if (a in capital or b in capital) and not {a, b} & capitals:
            add(capital.get(a, a), capital.get(b, b), CAPITALS * n)
    for joint in joints:
        for c in ALPHABET:
            if c.isalnum():
                add(_place(c), joint, JOINED * passed[_place(c)])
        for b, n in begun.items():
            add(joint, b, JOINED * n)
            add(joint, capital.get(b, b), CAPITALS * JOINED * n)
    for a in capital:
        for b, n in begun.items():
            if b in capital:
                add(a, capital[b], JOINED * passed[a] * n / passed[0])
    return out


def _samples(text: Column) -> tuple[Column, Column]:
    """Values of the base kinds, with the number of their kind, and the ordinary strings of the text around them."""
    none = F.array().cast("array<string>")

    def of_kind(kind: int, pattern: str) -> Column:
        found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.length(v) >= SAMPLE_LENGTH)
        return F.transform(F.when(text.rlike(pattern), found).otherwise(none), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("s")))

    values = F.concat(*(of_kind(kind, pattern) for kind, (pattern, _) in enumerate(BASE.values())))
    every = "|".join(pattern for pattern, _ in BASE.values())
    rest = F.when(text.rlike(every), F.regexp_replace(text, every, " ")).otherwise(text)
    return values, F.regexp_extract_all(rest, F.lit(_ORDINARY), F.lit(1))


def train(docs: DataFrame, text_col: str = "text") -> list[list[float]]:
    """For each random chain the log-likelihood ratio to the ordinary one of every transition, row by row.

    Both samples are taken from all rows; strings are counted before they are parted into characters. A repeated row
    counts again. Null and empty texts have no strings. A kind without values has a uniform chain; without ordinary
    strings all ratios are 0 and nothing is reported. Other columns are not read.
    """
    values, ordinary = _samples(F.col(text_col))
    random = _transitions(docs.select(F.explode(values).alias("v")).select("v.kind", "v.s", F.lit(1).alias("n")), "kind")
    counted = docs.select(F.explode(ordinary).alias("s")).groupBy("s").agg(F.count("*").alias("n")).withColumn("kind", F.lit(0))
    pairs = _transitions(counted, "kind").get(0)
    if not pairs:
        return [[0.0] * _STATES * _STATES] * (len(BASE) + 1)
    plain = _log_chain(_with_names(pairs))
    chains = [_log_chain(random.get(kind, {})) for kind in range(len(BASE))]
    alike = {_place(c) for c in ALPHABET if c.isalnum()}
    rest = len(ALPHABET) + 1 - len(alike)
    chains.append([math.log(0.99 / len(alike) if b in alike else 0.01 / rest) for _ in range(_STATES) for b in range(_STATES)])
    return [[a - b for a, b in zip(chain, plain, strict=True)] for chain in chains]


def _judged(spans: Column, model: list[list[float]]) -> Column:
    """Spans with the log-likelihood ratio of the random chain that makes their value likeliest to the ordinary chain.

    Characters, pairs and sums are made one after the other, so that none is made again for every chain.
    """
    tables = [F.from_json(F.lit(json.dumps(chain)), "array<double>") for chain in model]

    def pairs(c: Column) -> Column:
        return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))), c, lambda a, b: a * _STATES + b + 1)

    def total(at: Column, table: Column) -> Column:
        return F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.element_at(table, i))

    coded = F.transform(spans, lambda s: F.struct(s.alias("span"), F.transform(F.split(s["value"], ""), _state).alias("c")))
    paired = F.transform(coded, lambda x: F.struct(x["span"].alias("span"), pairs(x["c"]).alias("at")))
    return F.transform(paired, lambda x: F.struct(x["span"].alias("span"), F.greatest(*(total(x["at"], t) for t in tables)).alias("ratio")))


def ratio(string: Column, model: list[list[float]]) -> Column:
    """Log-likelihood ratio of the random chain that makes the string likeliest to the ordinary chain."""
    return F.get(_judged(F.array(F.struct(string.alias("value"))), model), F.lit(0))["ratio"]


def random_strings(text: Column, model: list[list[float]], threshold: float = THRESHOLD) -> Column:
    """Spans of all strings of a text that the chains call random, whether or not a base pattern matches them."""
    found = _judged(_labelled(_matches(text, _JUDGED, whole=True), len(BASE), "random"), model)
    return F.transform(F.filter(found, lambda x: x["ratio"] > threshold), lambda x: x["span"])


def scan(docs: DataFrame, model: list[list[float]], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: the id, ``base`` and ``spans``, all with kind, start, end and value, by start.

    Null and empty texts have no spans. Rows with equal ids or texts are scanned each for itself; other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col), base_spans(text).alias("base"), random_strings(text, model, threshold).alias("_random"))
    added = F.filter("_random", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select(id_col, "base", F.when(F.size("_random") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
