"""Personal data: patterns, and contextual extraction bootstrapped from what they find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuemill.llm._shared import BLANKS, durable, let, prefixes, spread_join

#: Kinds in the order in which spans at one place are listed; the last has no base pattern, only seeds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Seeds of secrets: long hexadecimal words with letters and digits.
SECRET = r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"

# A match can only begin where a run of its first characters begins, or where the last match ended (\G);
# with possessive runs a scan stays linear on long runs that lead nowhere.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: An identifier-like stretch: words in a row that hold a digit or an at sign.
_CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+"


def _found(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, value, before, after)`` of the leftmost non-overlapping matches, in code points."""
    def place(parts: Column) -> Column:
        gaps, values = parts["gaps"], parts["values"]
        steps = F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))
        return let(prefixes(steps, lambda x, y: x + y), lambda ends: F.transform(values, lambda v, i: F.named_struct(
            F.lit("start"), F.get(ends, i) - F.length(v), F.lit("end"), F.get(ends, i), F.lit("value"), v, F.lit("before"), F.get(gaps, i), F.lit("after"), F.get(gaps, i + 1))))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    from_right = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(from_right, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of ``(start, kind, end)`` of the valid pattern matches, sorted; null text: empty.

    Ends are exclusive; kinds are positions in :data:`KINDS`. A cheap test keeps texts
    without the characters a kind needs from its pattern.
    """
    text = F.coalesce(text, F.lit(""))
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(_SPAN)

    def of(i: int, kind: str) -> Column:
        good = F.filter(_found(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        return F.when(needs[kind], F.transform(good, lambda m: F.named_struct(F.lit("start"), m["start"], F.lit("kind"), F.lit(i), F.lit("end"), m["end"])).cast(_SPAN)).otherwise(none)

    return F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(BASE)]))


def _marks(spans: Column, length: Column) -> Column:
    """Array of ``(prev, start, kind)``: each group of overlapping spans (of its first one's kind) and where the last group ended; the end of the text comes last."""
    def of(ends: Column) -> Column:
        before = F.transform(spans, lambda s, i: F.named_struct(F.lit("prev"), F.coalesce(F.get(ends, i - 1), F.lit(0)), F.lit("start"), s["start"], F.lit("kind"), s["kind"]))
        stop = F.named_struct(F.lit("prev"), F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)), F.lit("start"), length, F.lit("kind"), F.lit(None).cast("int"))
        return F.concat(F.filter(before, lambda m: m["start"] >= m["prev"]), F.array(stop))

    return let(prefixes(F.transform(spans, lambda s: s["end"]), F.greatest), of)


def _cut(text: Column, many: Column) -> Callable[[Callable[[Callable], Column]], Column]:
    """Runs a body with a function of (start, end) that cuts the text; if ``many`` cuts follow, letters are parted once."""
    def run(body: Callable[[Callable], Column]) -> Column:
        letters = F.when(many, F.filter(F.split(text, ""), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
        part = lambda x: lambda a, b: F.when(F.size(x) > 0, F.array_join(F.slice(x, a + 1, b - a), "")).otherwise(F.substring(text, a + 1, b - a))
        return let(letters, lambda x: body(part(x)))

    return run


_WORD = r"[^\x20\x09-\x0D]++"
_AROUND = r"\"'(\[{<.,;:!?)\]}>\s"


def _words_before(text: Column, none: Column) -> Column:
    """The last two words of a text, lower-cased and joined by a space; ``none`` if it has none."""
    def of(t: Column) -> Column:
        last = lambda x: F.substring_index(x, " ", -1)
        two = let(F.struct(t.alias("t"), last(t).alias("w")), lambda x: F.struct(x["w"].alias("w"), F.rtrim(F.substring(x["t"], F.lit(1), F.length(x["t"]) - F.length(x["w"]))).alias("rest")))
        return F.when(t == "", none).otherwise(let(two, lambda x: F.lower(F.when(x["rest"] == "", x["w"]).otherwise(F.concat_ws(" ", last(x["rest"]), x["w"])))))

    return let(F.rtrim(F.translate(text, BLANKS, " " * len(BLANKS))), of)


def _words_behind(text: Column, none: Column) -> Column:
    """The first two words of a text, likewise."""
    def of(t: Column) -> Column:
        first = lambda x: F.substring_index(x, " ", 1)
        two = let(F.struct(t.alias("t"), first(t).alias("w")), lambda x: F.struct(x["w"].alias("w"), F.ltrim(F.substring(x["t"], F.length(x["w"]) + 1, F.length(x["t"]))).alias("rest")))
        return F.when(t == "", none).otherwise(let(two, lambda x: F.lower(F.when(x["rest"] == "", x["w"]).otherwise(F.concat_ws(" ", x["w"], first(x["rest"]))))))

    return let(F.ltrim(F.translate(text, BLANKS, " " * len(BLANKS))), of)


def _entry(start: Column, value: Column, left: Column, right: Column, kind: Column, known: bool, whole: bool) -> Column:
    """A candidate without blanks, quotes, brackets and punctuation around it."""
    lead = F.length(F.regexp_extract(value, f"^[{_AROUND}]*+", 0))
    inner = F.regexp_extract(value, f"(?s)^[{_AROUND}]*+(.*?)[{_AROUND}]*+$", 1)
    fields = {"start": start + lead, "end": start + lead + F.length(inner), "value": inner, "left": left, "right": right, "kind": kind, "known": F.lit(known), "whole": F.lit(whole)}
    return F.named_struct(*[x for n, c in fields.items() for x in (F.lit(n), c)])


def _parts(start: Column, m: Column, left: Column, right: Column, most: int) -> Column:
    """Runs of one to ``most`` words of a stretch that has more words than the run."""
    def of(w: Column) -> Column:
        def run(i: Column, k: int) -> Column:
            a, z = F.get(w, i), F.get(w, i + k)
            before = F.when(i > 1, F.concat_ws(" ", F.get(w, i - 2)["value"], F.get(w, i - 1)["value"])).when(i > 0, F.concat_ws(" ", F.element_at(F.split(left, " "), -1), F.get(w, i - 1)["value"])).otherwise(left)
            behind = F.when(i + k + 1 < F.size(w), F.concat_ws(" ", F.get(w, i + k + 1)["value"], F.coalesce(F.get(w, i + k + 2)["value"], F.get(F.split(right, " "), F.lit(0))))).otherwise(right)
            value = F.array_join(F.transform(F.slice(w, i + 1, F.lit(k + 1)), lambda x: F.concat(F.when(x["start"] == a["start"], F.lit("")).otherwise(x["before"]), x["value"])), "")
            return F.when((i + k < F.size(w)) & (F.size(w) > k + 1), _entry(start + m["start"] + a["start"], value, F.lower(before), F.lower(behind), F.lit(None).cast("int"), False, False))

        return F.flatten(F.transform(w, lambda _, i: F.filter(F.array(*[run(i, k) for k in range(most)]), lambda x: x.isNotNull())))

    return let(_found(m["value"], _WORD), of)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """Identifier-like stretches ``(id, text_hash, start, end, value, left, right, kind, known, whole)``.

    Base spans (``known``) and what lies between them: stretches of words that hold a
    digit or an at sign, whatever their length, and (not ``whole``) the runs of up to
    ``most`` words in a longer one; all without punctuation around them. ``kind`` is
    that of a base span or of a seed of a secret, else null; ``left`` and ``right`` are
    the two words beside, ``[]`` beside a base span, empty at the ends of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(text.rlike("[0-9@]")).select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("text_hash"), base_spans(F.col("text")).alias("base"))
    marks = _marks(F.col("base"), F.length("text"))
    piece = lambda cut: lambda m, i: F.named_struct(F.lit("at"), m["prev"], F.lit("text"), cut(m["prev"], m["start"]), F.lit("end"), m["start"], F.lit("kind"), m["kind"], F.lit("i"), i)
    pieces = _cut(F.col("text"), F.size("base") > 16)(lambda cut: F.transform(marks, piece(cut)))
    rows = rows.withColumn("pieces", pieces)
    edge = lambda there: F.when(there, F.lit("[]")).otherwise(F.lit(""))

    def stretches(p: Column, n: Column) -> Column:
        def of(m: Column) -> Column:
            beside = F.struct(_words_before(m["before"], edge(p["i"] > 0)).alias("l"), _words_behind(m["after"], edge(p["i"] + 1 < n)).alias("r"))
            return let(beside, lambda x: F.concat(F.array(_entry(p["at"] + m["start"], m["value"], x["l"], x["r"], F.lit(None).cast("int"), False, True)), _parts(p["at"], m, x["l"], x["r"], most)))

        return F.flatten(F.transform(_found(p["text"], _CANDIDATE), of))

    def seeds(ps: Column, cut: Callable) -> Column:
        def of(p: Column) -> Column:
            after = F.get(ps, p["i"] + 1)
            return F.named_struct(*[x for n, c in {
                "start": p["end"], "end": after["at"], "value": cut(p["end"], after["at"]), "left": _words_before(p["text"], edge(p["i"] > 0)),
                "right": _words_behind(after["text"], edge(p["i"] + 2 < F.size(ps))), "kind": p["kind"], "known": F.lit(True), "whole": F.lit(True)}.items() for x in (F.lit(n), c)])

        return F.transform(F.filter(ps, lambda p: p["kind"].isNotNull()), of)

    ps = F.col("pieces")
    found = F.concat(F.flatten(F.transform(ps, lambda p: stretches(p, F.size(ps)))), _cut(F.col("text"), F.size("base") > 16)(lambda cut: seeds(ps, cut)))
    out = rows.select("id", "text_hash", F.explode(found).alias("c")).select("id", "text_hash", "c.*").where(F.col("value") != "")
    return out.withColumn("kind", F.when(F.col("value").rlike(SECRET) & F.col("kind").isNull(), F.lit(KINDS.index("secret"))).otherwise(F.col("kind")))


def learn_identifiers(cands: DataFrame, *, rounds: int = 3, min_support: int = 5, confidence: float = 0.8) -> DataFrame:
    """Values that are seeds of secrets, or that contexts reveal to be identifiers, as ``(value_hash, kind, n)``; ``n`` counts their candidates.

    Seeds are the candidates with a kind. Each candidate belongs to lexical patterns:
    its exact shape; its coarse shape behind its left word or before its right word; the
    two words on its left or right, whatever its shape. In each round a pattern scores, per
    kind, the mean score of the instances it meets, and an instance the noisy-or of its confident patterns; only
    patterns with ``min_support`` different instances and that ``confidence`` count.
    The graph holds one row per pattern and instance, with its number of meetings, and
    every step is a grouped aggregate or an equi-join that deals frequent keys over
    tasks. Parts of stretches are scored, but count in no pattern.
    """
    letters = F.regexp_replace("value", r"\p{L}", "a")
    exact = F.regexp_replace(letters, "[0-9]", "9")
    coarse = F.regexp_replace(F.regexp_replace(exact, "a+", "a"), "9+", "9")
    near_left, near_right = F.element_at(F.split("left", " "), -1), F.get(F.split("right", " "), F.lit(0))
    two = lambda side: F.when(F.contains(side, F.lit(" ")), side)
    patterns = F.array_compact(F.array(
        F.concat(F.lit("s "), exact), F.concat(F.lit("l "), near_left, F.lit(" "), coarse), F.concat(F.lit("r "), near_right, F.lit(" "), coarse),
        F.concat(F.lit("ll "), two(F.col("left"))), F.concat(F.lit("rr "), two(F.col("right")))))
    met = cands.select(F.xxhash64("value").alias("value_hash"), "kind", F.col("whole").cast("long").alias("whole"), F.explode(patterns).alias("pattern"))
    graph = durable(met.groupBy("pattern", "value_hash").agg(F.sum("whole").alias("times"), F.count(F.lit(1)).alias("rows"), F.max("kind").alias("kind")), "pii-graph")
    total = graph.count()
    values = graph.groupBy("value_hash").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    values = durable(values, "pii-values")
    size = graph.groupBy("pattern").agg(F.sum("times").alias("total"), F.count_if(F.col("times") > 0).alias("support"), F.count(F.lit(1)).alias("n")).where(F.col("support") >= min_support)
    size = durable(size, "pii-patterns")
    seeds = values.where("kind is not null").select("value_hash", "n", F.array(F.struct("kind", F.lit(1.0).alias("score"))).alias("scores"))
    scores = seeds
    for _ in range(rounds):
        hits = spread_join(graph.select("pattern", "value_hash", "times").where("times > 0"), scores, "value_hash", F.col("pattern"), total).select("pattern", "times", F.explode("scores").alias("s"))
        hits = hits.groupBy("pattern", "s.kind").agg(F.sum(F.col("times") * F.col("s.score")).alias("hit"))
        strong = hits.join(size, "pattern").withColumn("conf", F.col("hit") / F.col("total")).where(F.col("conf") >= confidence - 1e-9)
        strong = durable(strong.groupBy("pattern").agg(F.collect_list(F.struct("kind", "conf")).alias("of"), F.max("n").alias("n")), "pii-strong")
        told = spread_join(graph.select("pattern", "value_hash"), strong, "pattern", F.col("value_hash"), total).select("value_hash", F.explode("of").alias("s"))
        told = told.groupBy("value_hash", "s.kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("s.conf"), F.lit(1e-9)))))).alias("score"))
        new = told.join(values.where("kind is null").select("value_hash", "n"), "value_hash").groupBy("value_hash").agg(F.max("n").alias("n"), F.collect_list(F.struct("kind", "score")).alias("scores"))
        scores = seeds.unionByName(durable(new, "pii-scores"))
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["kind"]).alias("back"))))
    found = scores.select("value_hash", best.alias("b")).where(F.col("b.score") >= confidence - 1e-9)
    return found.join(values.select("value_hash", F.col("kind").alias("seed"), F.col("rows").alias("n")), "value_hash").where(f"seed is null or seed = {KINDS.index('secret')}").select("value_hash", (-F.col("b.back")).alias("kind"), "n")


def _kept(found: Column) -> Column:
    """Spans apart from each other, from ``(start, back = -end, kind)``: the leftmost, then the longest, that begin behind the last one kept.

    Spans that meet, also by way of others, are one group; each group is gone through on its own.
    """
    row = lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("kind"), s["kind"], F.lit("end"), -s["back"])

    def chosen(group: Column) -> Column:
        add = lambda acc, s: F.when(F.coalesce(F.element_at(acc, -1)["end"] <= s["start"], F.lit(True)), F.concat(acc, F.array(row(s)))).otherwise(acc)
        return F.aggregate(F.slice(group, 2, F.size(group)), F.array(row(F.get(group, F.lit(0)))).cast(_SPAN), lambda acc, s: add(acc, s).cast(_SPAN))

    def of(ordered: Column) -> Column:
        reach = prefixes(F.transform(ordered, lambda s: -s["back"]), F.greatest)
        firsts = let(reach, lambda ends: F.filter(F.transform(ordered, lambda s, i: F.when(s["start"] >= F.coalesce(F.get(ends, i - 1), F.lit(0)), i)), lambda i: i.isNotNull()))
        groups = let(firsts, lambda f: F.transform(f, lambda i, k: F.slice(ordered, i + 1, F.coalesce(F.get(f, k + 1), F.size(ordered)) - i)))
        return F.flatten(F.transform(groups, chosen))

    return let(F.array_sort(found), of).cast(_SPAN)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of ``(start, kind, end)`` in code points; columns of these names are replaced.

    ``spans`` holds the base spans and the candidates between them that
    :func:`learn_identifiers` accepts, without those that begin within an earlier one
    (at one place the longest stays). Learned spans are joined by id and text hash, so rows
    with equal ids or null ids are safe; null and empty texts have no spans. Work grows
    with the length of a text times the logarithm of the number of its spans.
    """
    cands = durable(candidates(docs, id_col=id_col, text_col=text_col), "pii-candidates")
    learned = learn_identifiers(cands, **options)
    places = cands.where(~F.col("known")).select("id", "text_hash", "start", (-F.col("end")).alias("back"), F.xxhash64("value").alias("value_hash"))
    extra = spread_join(places, durable(learned, "pii-learned"), "value_hash", F.col("id"), cands.count())
    extra = durable(extra.groupBy(F.col("id").alias("extra_id"), F.col("text_hash").alias("extra_hash")).agg(_kept(F.collect_set(F.struct("start", "back", "kind"))).alias("extra")), "pii-spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"), base_spans(F.col(text_col)).alias("base_spans"))
    joined = rows.join(extra, F.col("row_id").eqNullSafe(F.col("extra_id")) & (F.col("row_hash") == F.col("extra_hash")), "left")
    spans = F.sort_array(F.concat("base_spans", F.coalesce("extra", F.array().cast(_SPAN))))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("base_spans", "spans")], "base_spans", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda cut: lambda m: F.concat(cut(m["prev"], m["start"]), F.coalesce(F.get(names, m["kind"]), F.lit("")))
    whole = _cut(text, F.size(spans) > 16)(lambda cut: F.array_join(F.transform(_marks(spans, F.length(text)), piece(cut)), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents with personal data replaced, columns unchanged; ``chars_col`` follows the new text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"))
    out = find(rows, id_col="row_id", text_col="row_text", **options).withColumn("row_text", redacted(F.col("row_text"), F.col("spans")))
    new = {text_col: F.col("row_text")}
    if chars_col in docs.columns:
        old = F.col("row").getField(chars_col)
        new[chars_col] = F.when(F.size("spans") > 0, F.length("row_text").cast(docs.schema[chars_col].dataType)).otherwise(old)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
