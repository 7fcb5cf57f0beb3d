"""Personal data by fixed patterns and by bootstrapped context, in DataFrame functions alone.

Base spans (email, ip, card, phone) come from regular expressions and checks of what they match. They are the seeds.
Instances are the base spans and, beside them, runs of words with digits that no base span touches, of any length; a
word within a run is one as well. A lexical pattern is the context of an instance: the two words before it, or one word before it that ends in ``:``, ``=`` or ``#``. Patterns and
instances form a graph whose edges are counted once for each value. Rounds alternate: a pattern's confidence is
the mean score of its instances and its support is their sum; an instance's score is 1 for a seed, else the highest
confidence among its patterns that are trusted (support of at least ``MIN_SUPPORT`` and confidence of at least
``MIN_CONFIDENCE``). Scores only grow, so rounds end when one adds no trusted pattern. Instances found by a trusted pattern are added as spans of the kind ``id``.

Regular expressions use possessive loops, which match the same but neither recurse nor go back, and a lookbehind
(or the end of the last match) where a match can't start inside a run, so their time grows with the text. So does that of
all else: what depends on the span before goes along the spans once, and pieces of a text are cut from chunks of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
MIN_SUPPORT, MIN_CONFIDENCE, CONTEXT = 5, 0.7, 60
SPANS = "array<struct<start:int,end:int,value:string,near:boolean>>"
_CHUNK = 64  # items of a scan whose outcomes are gathered by one aggregate, which copies what it holds at each step
_BITS = 8  # a text is cut into chunks of 2 ** _BITS code points


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (F.pmod(i, F.lit(2)) + 1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.when(F.length(_digits(v)).between(12, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, zero: Column, state: str, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step`` (state, item) -> (state, outcome) yields along ``items``, without nulls, as an array of ``kind``.

    One way along finds the state before each chunk; then the chunks' outcomes are gathered, each by itself.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        now, out = step(a["s"], x)
        return F.struct(now.cast(state).alias("s"), F.concat(a["out"], F.array_compact(F.array(out))).alias("out"))

    def whole(all_: Column) -> Column:
        part = lambda i: F.slice(all_, i * _CHUNK + 1, F.lit(_CHUNK))

        def ahead(a: Column, i: Column) -> Column:
            now = F.aggregate(part(i), a["s"], lambda s, x: step(s, x)[0].cast(state))
            return F.struct(now.alias("s"), F.concat(a["starts"], F.array(a["s"])).alias("starts"))

        first = F.struct(zero.cast(state).alias("s"), F.array().cast(f"array<{state}>").alias("starts"))
        starts = F.aggregate(F.sequence(F.lit(0), F.floor(F.size(all_) / _CHUNK).cast("int")), first, ahead, lambda a: a["starts"])
        outcomes = lambda s, i: F.aggregate(part(i), F.struct(s.alias("s"), none.alias("out")), one, lambda a: a["out"])
        return F.flatten(F.transform(starts, outcomes))

    return _let(items, whole)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << _BITS}}}+"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in chunks, in time that grows with their number alone."""
    low = F.shiftright(start, _BITS)
    near = F.array_join(F.slice(chunks, low + 1, F.shiftright(F.greatest(end - 1, start), _BITS) - low + 1), "")
    return F.when(end > start, F.substr(near, start - F.shiftleft(low, _BITS) + 1, end - start)).otherwise("")


def located(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Valid matches of ``pattern`` with start and end in code points: what lies between matches gives their places.

    ``near``: nothing but white space lies between the match and the one before it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        start = pos + F.length(x["gap"])
        end = start + F.length(x["hit"])
        near = ~x["gap"].rlike(r"[^\x20\x09-\x0D]")
        return end, F.when(valid(x["hit"]), F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), near.alias("near")))

    return _scan(pairs, F.lit(0), "int", step, SPANS[6:-1])


def _named(no: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), s["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end, value>> in order of start, then kind as listed."""
    found = []
    for no, kind in enumerate(KINDS):
        holds = text.contains("@") if kind == "email" else text.rlike(GUARDS[kind])
        spans = F.when(holds, located(text, PATTERNS[kind], VALID[kind])).otherwise(F.array().cast(SPANS))
        found.append(F.transform(spans, _named(no)))
    return F.array_sort(F.concat(*found))


_MARKED = "struct<start:int,end:int,word:boolean,value:string,near:boolean,apart:boolean>"


def _marked(words: Column, base: Column) -> Column:
    """``words`` with ``apart``: no span of ``base`` overlaps. Both lie in the order of their starts, so one way along them finds
    what began before a word, and the way back what begins within it."""

    def item(start: Column, end: Column, word: bool, value: Column, near: Column, apart: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(word).alias("word"), value.alias("value"), near.alias("near"), apart.alias("apart"))

    def again(x: Column, apart: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "word", "value", "near")), apart.alias("apart"))

    true = F.lit(True)
    own = F.transform(words, lambda w: item(w["start"], w["end"], True, w["value"], w["near"], true))
    others = F.transform(base, lambda b: item(b["start"], b["end"], False, F.lit(""), true, true))

    def forth(far: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["word"], far).otherwise(F.greatest(far, x["end"])), again(x, far <= x["start"])

    def back(next_: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["word"], next_).otherwise(x["start"]), F.when(x["word"], again(x, x["apart"] & (next_ >= x["end"])))

    there = _scan(F.array_sort(F.concat(own, others)), F.lit(0), "int", forth, _MARKED)
    both = F.reverse(_scan(F.reverse(there), F.lit((1 << 31) - 1), "int", back, _MARKED))
    return F.when(F.size(base) == 0, own).otherwise(both)


def _words(text: Column, base: Column) -> Column:
    """Runs of words with digits that no base span touches, then the words within them, without punctuation around them."""

    def bare(s: Column) -> Column:
        lead = F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^\p{L}0-9]++", ""))
        value = F.regexp_replace(s["value"], r"^[^\p{L}0-9]++|[^\p{L}0-9]++$", "")
        start = s["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), s["near"].alias("near"))

    def joined(words: Column, chunks: Column) -> Column:
        follows = F.transform(words, lambda w, i: F.struct(*(w[c].alias(c) for c in ("start", "end", "value", "apart")), ((i > 0) & w["near"] & F.get(words, i - 1)["apart"]).alias("within")))
        return _let(follows, lambda f: F.concat(runs(f, chunks), plain(F.filter(f, lambda w: w["apart"] & w["within"]))))

    def plain(words: Column) -> Column:
        return F.transform(words, lambda w: F.struct(*(w[c].alias(c) for c in ("start", "end", "value"))))

    def runs(words: Column, chunks: Column) -> Column:
        breaks = F.filter(F.transform(words, lambda w, i: F.when(~(w["apart"] & w["within"]), i)), lambda i: i.isNotNull())

        def run(at: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                w, last = F.get(words, i), F.get(words, F.coalesce(F.get(at, k + 1), F.size(words)) - 1)
                value = F.when(last["start"] == w["start"], w["value"]).otherwise(_cut(chunks, w["start"], last["end"]))
                return F.when(w["apart"], F.struct(w["start"].alias("start"), last["end"].alias("end"), value.alias("value")))

            return F.array_compact(F.transform(at, one))

        return _let(breaks, run)

    def whole() -> Column:
        bares = F.transform(located(text, WORD, lambda v: F.lit(True)), bare)
        return _let(_let(bares, lambda w: _let(base, lambda b: _marked(w, b))), lambda w: _let(_chunks(text), lambda c: joined(w, c)))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike("[0-9]"), whole()).otherwise(none)


def _patterns(before: Column) -> Column:
    """Lexical patterns of an instance from the text before it, lower-cased."""
    words = F.filter(F.split(F.lower(before), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    two = F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, -2, 2)))
    last = F.when(F.size(words) >= 1, F.element_at(words, -1))
    return F.array_compact(F.array(two, F.when(last.rlike(r"[\p{L}0-9][:=#]+$"), last)))


def _widest(spans: Column) -> Column:
    """Spans that lie in no other, in the order of their starts."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"))))
    step = lambda far, s: (F.greatest(far, -s["minus"]), F.when(-s["minus"] > far, F.struct(s["start"].alias("start"), (-s["minus"]).alias("end"))))
    return _scan(order, F.lit(-1), "int", step, "struct<start:int,end:int>")


def trusted_patterns(instances: DataFrame, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The patterns trusted in the end over ``instances`` (pattern, value, seed): rounds go on until one adds no pattern.

    An edge counts once whatever its copies; a value that is a seed anywhere is a seed. Sums have partial aggregates, so
    a pattern that a third of all instances share costs one row for each task.
    """
    edges = saved(instances.groupBy("pattern", "value").agg(F.max(F.col("seed").cast("int")).alias("seed")), "pii-edges")
    score = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    known = -1
    while True:
        rated = edges.join(score, "value").groupBy("pattern").agg(F.avg("score").alias("conf"), F.sum("score").alias("support"))
        trusted = saved(rated.filter((F.col("support") >= support) & (F.col("conf") >= confidence)), "pii-patterns")
        if (now := trusted.count()) == known:
            return trusted
        known = now
        reach = edges.join(trusted, "pattern", "left")
        score = reach.groupBy("value").agg(F.greatest(F.max("seed").cast("double"), F.coalesce(F.max("conf"), F.lit(0.0))).alias("score"))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, base, added`` of every whole text; ``added`` is array<struct<start, end>> of kind ``id``.

    ``text_key`` (xxhash64 of the text) tells rows with one doc_id apart. A null text counts as empty and has no spans;
    repeated rows have the same spans; an empty table gives no row; other columns are not read. Texts are scanned once;
    only spans and contexts are kept.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("known", base_spans(F.col("text")))
    rows = rows.withColumn("words", _words(F.col("text"), F.col("known")))

    def as_seen(spans: str, seed: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(*(s[n].alias(n) for n in ("start", "end", "value")), F.lit(seed).alias("seed")))


    def instances(chunks: Column) -> Column:
        before = lambda s: _cut(chunks, F.greatest(F.lit(0), s["start"] - CONTEXT), s["start"])
        seen = F.concat(as_seen("known", True), as_seen("words", False))
        return F.transform(seen, lambda s: F.struct(*(s[n].alias(n) for n in ("start", "end", "value", "seed")), _patterns(before(s)).alias("patterns")))

    some = (F.size("known") > 0) | (F.size("words") > 0)
    kept = saved(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.xxhash64("text").alias("text_key"),
            F.transform("known", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"))).alias("base"),
            F.when(some, _let(_chunks(F.col("text")), instances)).alias("instances"),
        ),
        "pii-spans",
    )
    each = kept.select("row", F.explode("instances").alias("i")).select("row", "i.start", "i.end", F.lower("i.value").alias("value"), "i.seed", F.explode("i.patterns").alias("pattern"))
    trusted = trusted_patterns(each.select("pattern", "value", "seed"))
    new = each.filter("not seed").join(trusted.select("pattern"), "pattern", "left_semi")
    added = new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("added"))
    added = added.withColumn("added", _widest(F.col("added")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return kept.drop("instances").join(added, "row", "left").select("doc_id", "text_key", "base", F.coalesce("added", none).alias("added"))


def kind_name(kind_no: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (*KINDS, "id"))), kind_no + 1)


def all_spans(base: Column, added: Column) -> Column:
    more = F.transform(added, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), s["end"].alias("end")))
    return F.array_sort(F.concat(base, more))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind_no"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span (in order of start) replaced by ``[KIND]``; of spans that overlap, the first names the rest."""

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        kept = F.struct(pos.alias("gap"), s["start"].alias("start"), s["kind_no"].alias("kind_no"))
        return F.greatest(pos, s["end"]), F.when(s["start"] >= pos, kept)

    def pieces(chunks: Column, own: Column) -> Column:
        named = F.transform(
            _scan(own, F.lit(0), "int", step, "struct<gap:int,start:int,kind_no:int>"),
            lambda s: F.concat(_cut(chunks, s["gap"], s["start"]), F.lit("["), F.upper(kind_name(s["kind_no"])), F.lit("]")),
        )
        tail = _cut(chunks, F.coalesce(F.array_max(F.transform(own, lambda s: s["end"])), F.lit(0)), F.length(text))
        return F.array_join(F.concat(named, F.array(tail)), "")

    return _let(_chunks(text), lambda c: _let(spans, lambda s: pieces(c, s)))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of ``documents``."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda no: F.size(F.filter("base", lambda s: s["kind_no"] == no)).cast("long")
    return found.select(
        "doc_id",
        *(count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(all_spans(F.col("base"), F.col("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
