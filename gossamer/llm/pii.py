"""Personal data by weak supervision, in DataFrame functions alone.

Base patterns find emails, IP addresses, payment cards and phone numbers; looser ones add candidates.
Labelers vote on each candidate: the pattern itself, gazetteers and checksums, the shape, words before
it. Expectation-maximisation over the counted vote patterns estimates each labeler's
reliability without any labels, and its posteriors train a final classifier on votes and length.
Base spans always stay; the classifier decides on the others. The work on a text grows a little faster than its number of
matches (m to the power 1.5 at most), never with its square: texts may be very long tables of figures.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, the base patterns (possessive where it makes no difference,
# so that long runs need no stack), gazetteers and cue words.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
EMAIL_RE = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_RE = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
# Runs of digits as [0-9]([\x20-]?[0-9])+ finds them, those of at least twelve: shorter ones are no cards, and no match starts inside a run.
CARD_RE = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE_RE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL_RE = r"(?i)[a-z0-9._%+-]{1,64}\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[a-z0-9-]{1,63}(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?[a-z0-9-]{1,63}|\.[a-z0-9-]{1,63}){1,6}"
LOOSE_PHONE_RE = r"(?<![\w.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])"
SECRET_RE = r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?[\"']?[a-z0-9_/+-]{16,200}"
TLDS = ("com", "net", "org", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "us", "it", "nl", "ch", "at", "be", "ca", "au", "jp", "in", "br", "mx")
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|logged in from|gateway|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|key)\b",
}
AGAINST = r"(?i)(?:\b(?:version|release|isbn|issn|doi|page|figure|section|chapter|invoice|order|serial|part)\b\W{0,3}(?:no\.?\W?)?|#|\bv)$"

LABELERS = ("pattern", "gazetteer", "shape", "context", "against")
YES, NO, SILENT = "1", "0", "-"
BEFORE = 40
EM_ROUNDS, ACCEPT = 40, 0.5
FOUND_TYPE = "array<struct<start:bigint,value:string,before:string>>"
#: Code points of the blocks in which a text is cut for redaction.
REDACT_BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often and deep inside lambdas body names it."""
    return F.transform(F.array(value), body).getItem(0)


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of bigints the fold of those before it; an array appended to is copied, so it is done in runs of the root of its size."""
    none = F.array().cast("array<bigint>")

    def fold(first: Column, xs: Column) -> Column:
        grown = F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return let(grown, lambda g: F.slice(g, F.lit(1), F.size(g) - 1))

    def cut(xs: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / n).cast("int") - 1), lambda k: F.slice(xs, k * n + 1, n))

    def joined(runs: Column) -> Column:
        heads = fold(start, F.transform(runs, lambda r: F.aggregate(r, start, step)))
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), heads.alias("head")), lambda z: fold(z["head"], z["run"])))

    return F.when(F.size(values) == 0, none).otherwise(let(values, lambda xs: let(cut(xs), joined)))


def located(text: Column, guard: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their starts in code points and up to 40 characters before, no more than to the
    match before the last; nothing where the guard fails."""
    none = F.array().cast(FOUND_TYPE)

    def placed(s: Column) -> Column:
        gaps, values = s["gaps"], s["found"]
        width = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: (F.length(g) + F.length(v)).cast("bigint"))
        until = running(width, F.lit(0).cast("bigint"), lambda a, b: a + b)

        def one(v: Column, i: Column) -> Column:
            gap = F.element_at(gaps, i + 1)
            past = F.when((i > 0) & (F.length(gap) < BEFORE), F.concat(F.element_at(gaps, F.greatest(i, F.lit(1))), F.element_at(values, F.greatest(i, F.lit(1))), gap)).otherwise(gap)
            return F.struct(F.length(gap).cast("bigint").alias("start"), v.alias("value"), F.right(past, F.lit(BEFORE)).alias("before"))

        return F.zip_with(until, F.transform(values, one), lambda at, x: F.struct((at + x["start"]).alias("start"), x["value"].alias("value"), x["before"].alias("before")))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(guard, let(parts, placed)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid_ip(value: Column) -> Column:
    """Each part at most 255; of three digits left without leading zeros, text order is number order."""

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), small)


def valid_card(value: Column) -> Column:
    return F.length(digits(value)).between(12, 19) & F.call_function("luhn_check", digits(value))


def valid_phone(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def _votes(kind: str, x: Column, base: bool) -> Column:
    """One sign per labeler."""
    value, before = x["value"], x["before"]
    said = lambda c: F.when(c, YES).otherwise(NO)
    pattern = F.lit(YES if base or kind == "secret" else NO)
    tail = F.lower(F.regexp_extract(value, r"([A-Za-z]+)[)\]}]?$", 1))
    gazetteer = {
        "email": lambda: said(tail.isin(*TLDS)),
        "ip": lambda: said(~value.rlike(r"^0*(?:0|255)\.|^127\.")),
        "card": lambda: said(F.call_function("luhn_check", digits(value)) & digits(value).rlike("^[3-6]")),
        "phone": lambda: said(F.length(digits(value)).between(9, 13)),
        "secret": lambda: said(value.rlike(r"[0-9]") & value.rlike(r"(?i)[a-z0-9_/+-]{20,}$")),
    }[kind]()
    shape = {
        "email": lambda: said(value.rlike(r"(?i)^[^@(\[{]*[a-z]")),
        "ip": lambda: said(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")),
        "card": lambda: said(value.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$")),
        "phone": lambda: said(value.rlike(r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}$")),
        "secret": lambda: said(~value.rlike(r"[=:]\x20?[\"']?[A-Za-z]+$")),
    }[kind]()
    context = F.when(before.rlike(CUES[kind]), YES).otherwise(SILENT) if kind != "secret" else F.lit(SILENT)
    against = F.when(before.rlike(AGAINST), NO).otherwise(SILENT)
    return F.concat(pattern, gazetteer, shape, context, against)


def _typed(kind: str, found: Column, base: bool) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), F.lit(base).alias("base"),
            _votes(kind, x, base).alias("votes"), F.least(F.floor(F.length(x["value"]) / 8), F.lit(4)).cast("int").alias("size"),
        ),
    )


def candidates(docs: DataFrame, secrets: bool = False) -> DataFrame:
    """docs with a column ``candidates``: array<struct<kind, start, end, base, votes, size>>; with ``secrets`` also credentials."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = text.contains("[at]") | text.contains("(at)") | text.rlike(r"(?i)[(\[{]\x20?at\x20?[)\]}]")
    cards = located(text, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), CARD_RE)
    found = {
        "email": F.when(text.contains("@"), located(text, text.rlike(r"@[A-Za-z0-9-]++\."), EMAIL_RE)).otherwise(F.array().cast(FOUND_TYPE)),
        "ip": F.filter(located(text, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP_RE), lambda x: valid_ip(x["value"])),
        "card": cards,
        "phone": F.filter(located(text, text.contains("+") & text.rlike(r"\+[0-9]"), PHONE_RE), lambda x: valid_phone(x["value"])),
    }
    loose = {
        "email": located(text, marked, LOOSE_EMAIL_RE),
        "phone": located(text, text.rlike(LOOSE_PHONE_RE), LOOSE_PHONE_RE),
        "secret": located(text, text.rlike(SECRET_RE), SECRET_RE) if secrets else F.array().cast(FOUND_TYPE),
    }
    out = docs.drop("__email", "__ip", "__card", "__phone", "__loose_email", "__loose_phone", "__loose_secret", "candidates")
    out = out.withColumns({f"__{k}": v for k, v in found.items()} | {f"__loose_{k}": v for k, v in loose.items()})
    sure = F.concat(
        _typed("email", F.col("__email"), True), _typed("ip", F.col("__ip"), True),
        _typed("card", F.filter("__card", lambda x: valid_card(x["value"])), True), _typed("phone", F.col("__phone"), True),
    )
    maybe = F.concat(
        _typed("email", F.col("__loose_email"), False),
        # Card-like numbers whose check digit fails.
        _typed("card", F.filter("__card", lambda x: ~valid_card(x["value"]) & F.length(digits(x["value"])).between(13, 16)), False),
        _typed("phone", F.col("__loose_phone"), False), _typed("secret", F.col("__loose_secret"), False),
    )
    out = out.withColumn("__sure", sure).withColumn("__maybe", maybe)
    free = F.when((F.size("__sure") == 0) | (F.size("__maybe") == 0), F.col("__maybe")).otherwise(_apart(F.col("__maybe"), F.col("__sure")))
    out = out.withColumn("candidates", F.concat("__sure", free))
    return out.drop("__sure", "__maybe", *(f"__{k}" for k in found), *(f"__loose_{k}" for k in loose))


def _apart(maybe: Column, sure: Column) -> Column:
    """Those of maybe that overlap none of sure: in the order of starts, no sure span before reaches in and the next begins behind."""
    end = F.lit(2**62).cast("bigint")
    tagged = lambda spans, loose: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(loose).alias("loose"), x.alias("span")))  # noqa: E731  of equal starts the sure one first

    def chosen(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda r: F.when(r["loose"], F.lit(0).cast("bigint")).otherwise(r["span"]["end"].cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))
        behind = F.reverse(running(F.reverse(F.transform(rows, lambda r: F.when(~r["loose"], r["start"]).otherwise(end))), end, lambda a, b: F.least(a, b)))
        zipped = F.arrays_zip(rows.alias("r"), reach.alias("reach"), behind.alias("behind"))
        kept = F.filter(zipped, lambda z: z["r"]["loose"] & (z["reach"] <= z["r"]["start"]) & (z["behind"] >= z["r"]["span"]["end"]))
        return F.transform(kept, lambda z: z["r"]["span"])

    return let(F.array_sort(F.concat(tagged(sure, False), tagged(maybe, True))), chosen)


@dataclass
class PiiModel:
    """Reliabilities by kind and labeler (P(yes | private), P(yes | not)), priors, and the accepted patterns with their scores."""

    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    accepted: dict[str, float] = field(default_factory=dict)


def _expectation_maximisation(rows: list[tuple[str, int]]) -> tuple[float, list[tuple[float, float]], dict[str, float]]:
    """Two-class EM over vote patterns and their counts; silent labelers say nothing. Starts from the majority vote."""
    post = {}
    for votes, _ in rows:
        yes, no = votes.count(YES), votes.count(NO)
        post[votes] = (yes + 0.5) / (yes + no + 1)
    prior, rel = 0.5, [(0.8, 0.2)] * len(LABELERS)
    for _ in range(EM_ROUNDS):
        total = sum(n for _, n in rows)
        prior = min(0.98, max(0.02, (sum(post[v] * n for v, n in rows) + 1) / (total + 2)))
        rel = []
        for k in range(len(LABELERS)):
            # Beta priors of a labeler that is right four times in five keep rare ones sane.
            a = 4.0 + sum(post[v] * n for v, n in rows if v[k] == YES), 1.0 + sum(post[v] * n for v, n in rows if v[k] == NO)
            b = 1.0 + sum((1 - post[v]) * n for v, n in rows if v[k] == YES), 4.0 + sum((1 - post[v]) * n for v, n in rows if v[k] == NO)
            rel.append((a[0] / sum(a), b[0] / sum(b)))
        for v, _ in rows:
            odds = math.log(prior / (1 - prior))
            for sign, (p, q) in zip(v, rel, strict=True):
                odds += math.log(p / q) if sign == YES else math.log((1 - p) / (1 - q)) if sign == NO else 0.0
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, rel, post


def _final_classifier(rows: list[tuple[str, int, int]], post: dict[str, float], steps: int = 300, rate: float = 0.5) -> dict[tuple[str, int], float]:
    """Logistic regression on votes and length, trained on the posteriors; its probability of each pattern."""

    def features(votes: str, size: int) -> list[float]:
        return [1.0 if s == YES else -1.0 if s == NO else 0.0 for s in votes] + [1.0 if size == k else 0.0 for k in range(5)] + [1.0]

    xs = [(features(v, s), post[v], n) for v, s, n in rows]
    total = sum(n for _, _, n in xs) or 1
    w = [0.0] * (len(LABELERS) + 6)
    prob = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
    for _ in range(steps):
        grad = [-1e-3 * a for a in w]
        for x, y, n in xs:
            d = (y - prob(x)) * n / total
            for k, a in enumerate(x):
                grad[k] += d * a
        w = [a + rate * g * 4 for a, g in zip(w, grad, strict=True)]
    return {(v, s): prob(features(v, s)) for v, s, _ in rows}


def fit(found: DataFrame) -> PiiModel:
    """A model of a table with ``candidates``. What reaches the driver is one row per kind, vote pattern and length class: at most 5 x 3^5 x 5, whatever the input."""
    each = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.size").count().collect()
    model = PiiModel()
    for kind in KINDS:
        rows = sorted((r["votes"], r["size"], r["count"]) for r in each if r["kind"] == kind)
        if not rows:
            continue
        by_votes: dict[str, int] = {}
        for v, _, n in rows:
            by_votes[v] = by_votes.get(v, 0) + n
        model.prior[kind], model.reliability[kind], post = _expectation_maximisation(sorted(by_votes.items()))
        scores = _final_classifier(rows, post)
        model.accepted |= {f"{kind}|{v}|{s}": p for (v, s), p in scores.items() if p >= ACCEPT}
    return model


def order_key(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def accepted_spans(found: DataFrame, model: PiiModel) -> DataFrame:
    """The table with ``spans`` in place of ``candidates``: array<struct<start, rank, end, kind, base>>, in order."""
    known = F.array(*[F.lit(k) for k in sorted(model.accepted)]).cast("array<string>")
    keep = F.filter("candidates", lambda c: c["base"] | F.array_contains(known, F.concat_ws("|", c["kind"], c["votes"], c["size"].cast("string"))))
    spans = F.array_sort(F.transform(keep, lambda c: F.struct(c["start"].alias("start"), order_key(c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))))
    return found.withColumn("spans", spans).drop("candidates")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: PiiModel | None = None, secrets: bool = False) -> DataFrame:
    """docs with ``spans``; without a model, one fitted on all of docs.

    Nulls: a null text is empty and has no spans. All rows stay, repeated ones too. An empty table
    gives a model without candidates and no rows. Columns spans and candidates of the input are replaced.
    """
    return accepted_spans(candidates(docs, secrets), model or fit(candidates(docs.select("text"), secrets)))


def redact(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """docs with the spans of each text replaced by their kind in brackets, and n_chars counted anew; without the spans.

    Of overlapping spans the one that starts first is replaced, and what the others have beyond it goes with them.
    """
    text = F.col("text")

    def rebuilt(s: Column) -> Column:
        found, blocks = s["spans"], s["blocks"]
        reach = running(F.transform(found, lambda x: x["end"].cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))

        def between(lo: Column, hi: Column) -> Column:
            first = F.floor(lo / REDACT_BLOCK).cast("int")
            some = F.slice(blocks, first + 1, F.floor(hi / REDACT_BLOCK).cast("int") - first + 1)
            return F.substring(F.array_join(some, ""), (lo - first * REDACT_BLOCK + 1).cast("int"), (hi - lo).cast("int"))

        marks = F.zip_with(found, reach, lambda x, at: F.when(x["start"] >= at, F.concat(between(at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit("")))
        return F.concat(F.array_join(marks, ""), between(F.array_max(F.transform(found, lambda x: x["end"].cast("bigint"))), s["length"]))

    parts = F.struct(F.col(spans).alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{REDACT_BLOCK}}}"), F.lit(0)).alias("blocks"), F.length(text).cast("bigint").alias("length"))
    clean = let(parts, rebuilt)
    out = docs.withColumn("text", F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(clean)).drop(spans)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out
