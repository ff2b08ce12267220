r"""Operator 9: personal data by generated candidates, boosted trees and calibrated thresholds.

Base spans (e-mail, IP address, card, phone) follow fixed patterns and always count. High-recall
generators propose further spans that may overlap: number-like runs, long tokens, address-like
words. Each has features of its format (lengths, digits, separators, groups, check digit) and of
its context (words before it, signs around it). Gradient-boosted trees learn from a bounded
sample of candidates, stratified by generator and label; the label a rule knows: base spans and
values assigned to a name like "token" or "password" are personal, the rest is not. For each
generator the threshold is the lowest score whose precision, over all candidates outside the
fit, is at least ``precision``; candidates above it are added unless a base span covers a part
of them.

Everything is DataFrame functions and Spark ML: no Python runs on executors. Positions come
from what lies between matches: a text splits at a pattern into one more part than it has
matches. Patterns take linear time: runs start where the run starts and don't give back, and
separators that a pattern repeats are first replaced by one marker character each (positions
stay), so that no group is repeated on the regex engine's stack.

Null texts are empty. Positions are code points, end exclusive. Repeated rows keep their rows.
Without candidates of both labels there is no model, and base spans are all.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import plain, store

BASE = ("email", "ip", "card", "phone")
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Markers: 1 for a single blank or hyphen between digits, 3 for a dot before a label.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+\x03-])|\G)[A-Za-z0-9._%+\x03-]++@[A-Za-z0-9-]++\x03[A-Za-z0-9\x03-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9\x01])[0-9][0-9\x01]{12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9][\x20().0-9/-]{5,}[0-9](?![0-9A-Za-z])",
    # A sign = is padding at the end of a value and otherwise stands before one.
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+(?:={1,2}+(?![A-Za-z0-9_+/=-]))?+",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?|@)[A-Za-z0-9-]++",
}
KINDS = (*BASE, *GENERATORS)
_NAMED = r"(?i)(token|key|secret|passw(or)?d|pwd)['\"]?\x20{0,2}[=:]\x20{0,2}['\"]?$"
FEATURES = (
    "size", "digits", "letters", "capitals", "separators", "groups", "signs", "digit_share", "mixed", "check",
    "plus", "named", "hinted", "quoted", "after", "generator",
)


_PIECE = 256  # elements that one inner aggregate takes


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _scan(items: Column, start: dict[str, Column], step, kind: str, local=None) -> Column:
    """array<kind> with an output of ``step`` per element, from left to right. ``step`` gets the
    state, the element and what ``local`` makes of the state and a piece of the elements, and
    returns the next state and the output.

    Appending copies an array; outputs are gathered by pieces, and then the pieces, so that a
    long array takes about linear time.
    """
    none = F.array().cast(f"array<{kind}>")
    state = lambda fields, out: F.struct(*(c.alias(n) for n, c in fields.items()), out.alias("out"))

    def piece(items, done, i):
        last, some = F.element_at(done, -1), F.slice(items, i + 1, _PIECE)

        def one(seen):
            def merge(before, x):
                fields, out = step(before, x, seen)
                return state(fields, F.concat(before["out"], F.array(out)))

            return F.aggregate(some, state({n: last[n] for n in start}, none), merge)

        whole = one(None) if local is None else _let(local(last, some), one)
        return F.concat(done, F.array(whole))

    def run(items):
        firsts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(_PIECE))).otherwise(F.array().cast("array<int>"))
        done = F.aggregate(firsts, F.array(state(start, none)), lambda done, i: piece(items, done, i))
        return F.flatten(F.transform(done, lambda d: d["out"]))

    return _let(items, run)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of all matches, left to right; ``before`` is the
    text before the match, whether an earlier match covers it or not.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = _let(found, lambda f: F.arrays_zip(f.alias("value"), F.slice(between, F.lit(1), F.size(f)).alias("before")))

    def step(state, x, _):
        begin = state["at"] + F.length(x["before"])
        end = begin + F.length(x["value"])
        before = F.right(F.concat(state["last"], x["before"]), F.lit(32))
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"))
        return {"at": end, "last": F.right(F.concat(before, x["value"]), F.lit(32))}, one

    return _scan(pairs, {"at": F.lit(0), "last": F.lit("")}, step, "struct<start:int,end:int,value:string,before:string>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others."""
    backwards = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    total = F.aggregate(
        F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _sound(kind: str, spans: Column) -> Column:
    """Failing matches go; nothing is retried."""
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _as(kind: int, spans: Column, *more: str) -> Column:
    """The spans as structs that begin with their kind's number."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), *(s[c].alias(c) for c in ("start", "end", *more))))


def _marked(text: Column) -> dict[str, Column]:
    """The text in which each kind is searched, of the same length in code points."""
    # Marker characters that are there already become another control character.
    free = F.translate(text, "\x01\x03", "\x02\x02")
    return {
        "email": F.regexp_replace(free, r"\.(?=[A-Za-z0-9-])", "\x03"),
        "ip": free,
        "card": F.regexp_replace(free, r"(?<=[0-9])[\x20-](?=[0-9])", "\x01"),
        "phone": free,
    }


_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(row, key, base: map-like struct of span arrays, candidates), stored; with the text if
    ``keep_text``.
    """
    rows = plain(docs, **{key: "long", text: "string"}).toDF("key", "text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    marked = _marked(F.col("text"))
    rows = rows.withColumns({f"in_{k}": F.when(F.col("text").rlike(_NEEDS[k]), c) for k, c in marked.items()})
    spans = {k: F.when(F.col(f"in_{k}").isNull(), none).otherwise(_spans(F.col(f"in_{k}"), PATTERNS[k])) for k in BASE}
    found = {g: _spans(F.col("text"), p) for g, p in GENERATORS.items()}
    kept = [_sound(k, spans[k]).alias(k) for k in BASE]
    return store(
        rows.select("key", F.monotonically_increasing_id().alias("row"), *(["text"] if keep_text else []), *kept,
                    *(c.alias(f"found_{g}") for g, c in found.items())),
        "spans",
    )


def _features(found: DataFrame) -> DataFrame:
    """A row per candidate: row, kind, start, end, features, label, whether a base span overlaps."""
    # Base spans and candidates in one order of starts, base spans first where starts are equal.
    def placed_as(kind, spans, value, before):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), value(s).alias("value"), before(s).alias("before")))

    empty = lambda s: F.lit("")
    own = [placed_as(i, F.col(f"found_{g}"), lambda s: s["value"], lambda s: s["before"]) for i, g in enumerate(GENERATORS)]
    base = placed_as(-1, _base_spans(), empty, empty)
    placed = found.filter(sum(F.size(f"found_{g}") for g in GENERATORS) > 0).select("row", F.array_sort(F.concat(base, *own)).alias("all"))
    is_base = lambda x: x["kind"] < 0
    reach = lambda s, x, _: ({"end": F.when(is_base(x), F.greatest(s["end"], x["end"])).otherwise(s["end"])}, s["end"] > x["start"])
    ahead = lambda s, x, _: ({"start": F.when(is_base(x), x["start"]).otherwise(s["start"])}, s["start"] < x["end"])
    marked = placed.select(
        "row", "all",
        _scan(F.col("all"), {"end": F.lit(0)}, reach, "boolean").alias("under"),
        F.reverse(_scan(F.reverse("all"), {"start": F.lit(2**31 - 1)}, ahead, "boolean")).alias("over"),
    )
    one = marked.select("row", F.explode(F.arrays_zip("all", "under", "over")).alias("c")).filter("c.all.kind >= 0")
    one = one.select("row", "c.all.*", (F.col("c.under") | F.col("c.over")).alias("overlaps"))
    value, before = F.col("value"), F.col("before")
    count = lambda pattern: F.length(F.regexp_replace(value, pattern, "")).cast("double")
    flag = lambda c: c.cast("double")
    overlaps = F.col("overlaps")
    named = before.rlike(_NAMED)
    return one.select(
        "row", "start", "end", F.col("kind").cast("double").alias("generator"),
        F.length(value).cast("double").alias("size"),
        count("[^0-9]").alias("digits"),
        count("[^A-Za-z]").alias("letters"),
        count("[^A-Z]").alias("capitals"),
        count("[A-Za-z0-9]").alias("separators"),
        count(r"(?<=[0-9])[0-9]|[^0-9]").alias("groups"),
        count(r"[^@/=_]").alias("signs"),
        (count("[^0-9]") / F.length(value)).alias("digit_share"),
        flag(value.rlike("[A-Za-z][0-9]+[A-Za-z]")).alias("mixed"),
        flag(F.length(_digits(value)).between(13, 19) & luhn(F.substring(_digits(value), 1, 24))).alias("check"),
        flag(value.startswith("+") | before.endswith("+")).alias("plus"),
        flag(named).alias("named"),
        flag(before.rlike(r"(?i)\b(tel|phone|fon|call|mobile?|fax|card|carte|karte|tarjeta|ip|host|mail|e-mail|ssn|iban|id)\b.{0,6}$")).alias("hinted"),
        flag(before.rlike("['\"]$")).alias("quoted"),
        flag(before.rlike("[A-Za-z0-9]$")).alias("after"),
        flag(overlaps | (named & (F.length(value) >= 16))).alias("label"),
        overlaps.alias("covered"),
    )


def learn(candidates: DataFrame, sample: int = 20_000, precision: float = 0.9, trees: int = 12, depth: int = 4):
    """(model, threshold per generator, the candidates with their scores, stored), or None.

    The trees are fitted to at most about ``sample`` candidates, an equal share of each generator
    and label. Thresholds come from all candidates outside the fit; a generator's candidates of a
    label count for those of them that the fit took.
    """
    strata = {(r["generator"], r["label"]): r["n"] for r in candidates.groupBy("generator", "label").agg(F.count("*").alias("n")).collect()}
    if len({label for _, label in strata}) < 2:
        return None
    draw = F.pmod(F.xxhash64("row", "start", "end", "generator"), F.lit(1 << 20)) / F.lit(1 << 20)
    fold = F.pmod(F.xxhash64("row", F.lit("fold")), F.lit(4))
    rate = F.lit(0.0)
    for (g, label), n in strata.items():
        rate = F.when((F.col("generator") == g) & (F.col("label") == label), F.lit(sample / len(strata) / n)).otherwise(rate)
    # A quarter of the rows is never in the fit, so that rare candidates are left for the thresholds.
    drawn = (fold > 0) & (draw < rate)
    fit = store(candidates.filter(drawn), "labelled")
    if fit.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, labelCol="label").fit(assembler.transform(fit))
    scored = store(
        _score(candidates.withColumn("fitted", drawn), model).select("row", "start", "end", "generator", "label", "covered", "fitted", "score"),
        "scored",
    )
    step = F.floor(F.col("score") * 100).alias("step")
    steps = scored.filter(~F.col("fitted")).groupBy("generator", "label", step).agg(F.count("*").alias("n")).collect()
    return model, thresholds(strata, [(r["generator"], r["label"], r["step"], r["n"]) for r in steps], precision), scored


def thresholds(strata: dict, steps: list[tuple], precision: float) -> dict[int, float]:
    """The lowest score of each generator at which the precision holds, from the numbers of
    candidates by (generator, label) and of those outside the fit by (generator, label, step).
    """
    outside = {s: sum(n for g, label, _, n in steps if (g, label) == s) for s in strata}
    out = {}
    for g in range(len(GENERATORS)):
        total = good = 0.0
        own = [(step, label, n * strata[g, label] / outside[g, label]) for of, label, step, n in steps if of == g]
        # Scores from high to low; the lowest step at which the precision still holds.
        for step in sorted({step for step, _, _ in own}, reverse=True):
            total += sum(n for at, _, n in own if at == step)
            good += sum(n for at, label, n in own if at == step and label)
            if good >= precision * total and step >= 50:
                out[g] = step / 100
    return out


def _score(candidates: DataFrame, model) -> DataFrame:
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(candidates)
    return model.transform(assembled).withColumn("score", vector_to_array("probability")[1])


def spans(found: DataFrame) -> DataFrame:
    """(row, extra): the added spans of each row that has some."""
    candidates = _features(found)
    known = learn(candidates)
    if known is None or not known[1]:
        return found.select("row", F.array().cast("array<struct<kind:int,start:int,end:int>>").alias("extra")).limit(0)
    _, least_scores, scored = known
    least = F.lit(None).cast("double")
    for g, t in least_scores.items():
        least = F.when(F.col("generator") == g, F.lit(t)).otherwise(least)
    chosen = scored.filter(~F.col("covered") & (F.col("score") >= least))
    kind = F.lit(len(BASE)) + F.col("generator").cast("int")
    return chosen.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(kind.alias("kind"), "start", "end"))).alias("extra"))


def _base_spans() -> Column:
    """The base spans of a row as structs (kind number, start, end), by kind, then start."""
    return F.concat(*(_as(i, F.col(k)) for i, k in enumerate(BASE)))


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row."""
    found = find(docs, key, text)
    joined = found.join(spans(found), "row", "left")
    base = _base_spans()
    everything = F.concat(base, F.coalesce("extra", F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    return joined.select(
        F.col("key").alias(key),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(everything).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets, for example
    ``[EMAIL]``; where spans overlap, the first one names the whole stretch. Null texts stay
    null, other columns stay.
    """
    names, place = docs.columns, docs.columns.index(text)
    # No name of the table meets a name given here.
    inner = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("number", F.monotonically_increasing_id())
    numbered = store(inner, "numbered")
    found = find(numbered, "number", f"c{place}")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    every = found.join(spans(found), "row", "left").select(
        F.col("key").alias("number"), F.concat(_base_spans(), F.coalesce("extra", none)).alias("spans")
    )
    every = every.filter(F.size("spans") > 0)
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    body = F.col(f"c{place}").cast("string")
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    last_end = lambda some: F.array_max(F.transform(some, lambda s: s["end"]))

    def stretch(state, some):
        """What a piece of the spans can need of the text, and where it begins."""
        return F.struct(state["at"].alias("at"), F.substring(body, state["at"] + 1, F.greatest(last_end(some) - state["at"], F.lit(0))).alias("text"))

    def step(state, s, of):
        part = F.concat(F.substring(of["text"], state["at"] - of["at"] + 1, s["start"] - state["at"]), F.get(label, s["kind"]))
        return {"at": F.greatest(state["at"], s["end"])}, F.when(s["start"] >= state["at"], part).otherwise("")

    parts = _scan(by_start, {"at": F.lit(0)}, step, "string", stretch)
    cleaned = F.concat(F.array_join(parts, ""), F.substring(body, last_end(F.col("spans")) + 1, F.length(body)))
    joined = numbered.join(every, "number", "left")
    columns = [F.when(F.col("spans").isNull(), body).otherwise(cleaned) if i == place else F.col(f"c{i}") for i in range(len(names))]
    return joined.select(*columns).toDF(*names)
