"""Personal data: exact base rules, and boosted trees that pick further spans among candidates.

DataFrame, SQL and ML functions only. Base spans are the leftmost non-overlapping matches of one
pattern per kind that pass the kind's test. High-recall generators propose more, overlapping
spans (spelled-out mail addresses, dotted numbers, grouped digits read as phone or as card). Each
candidate has format and context features; gradient-boosted trees score it; per kind, the least
threshold whose precision on held-out candidates reaches ``PRECISION`` selects. Of overlapping
selected candidates the likeliest stays, and none is added where a base span is.

There are no labelled spans, so candidates are labelled by rule: 1 where a candidate is a base
span, 0 where it cannot be personal data of its kind (a part over 255, a failing check digit, a
date, a bare run of digits), and none (not used in the fit) otherwise - these are the ones that
only the trees judge. The fit uses at most about ``SAMPLE`` candidates; the trees become a SQL
expression, so texts are scanned once and nothing is exploded or shuffled to score them.

Positions: a match and the gap before it are taken together (``\\G(.*?)(pattern)``), so ends are
running sums of lengths in code points. Patterns are possessive wherever that matches the same,
which keeps them linear in practice and off the stack for long runs of digits.

Defined cases: a null text is an empty one; it has no spans, and the digest of the empty string;
repeated rows each have their result; without candidates of both labels nothing is added; other
columns are never looked at by ``find`` and pass through ``redact`` untouched.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns (possessive forms of the same languages). A run that holds no
#: match from its start holds none further on, so it is tried from there (or from where the last
#: match ended) only, which keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to match at all.
HINT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
#: Generators: pattern and hint. A digit group proposes a phone and a card.
GENERATORS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
        lambda t: t.contains("@") | t.contains("(at)") | t.contains("[at]"),
    ),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){2,}+", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
    "digits": (r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+", lambda t: t.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}")),
}
SAMPLE = 20_000
PRECISION = 0.95
TREES, DEPTH = 12, 3
CONTEXT = 24


def matches(text: Column, pattern: str, hint: Column) -> tuple[Column, Column]:
    """Gaps and bodies of the leftmost non-overlapping matches, in order."""
    anchored = rf"(?s)\G(.*?)({pattern})"
    empty = F.array().cast("array<string>")
    return tuple(F.when(hint, F.regexp_extract_all(text, F.lit(anchored), F.lit(g))).otherwise(empty) for g in (1, 2))


def positioned(df: DataFrame, name: str, kind: int, gaps: str, bodies: str) -> DataFrame:
    """Adds the array of spans ``name`` from gaps and bodies; drops both."""
    lens, sums = f"_{name}_len", f"_{name}_sum"
    df = df.withColumn(lens, F.zip_with(gaps, bodies, lambda g, b: F.length(g) + F.length(b)))
    # sums of whole blocks of 256 first: a running sum over a long list stays cheap
    df = df.withColumn(
        sums,
        F.expr(f"transform(sequence(0, size({lens}) div 256), b -> aggregate(slice({lens}, 1, b * 256), 0, (s, x) -> s + x))"),
    )
    end = f"{sums}[i div 256] + aggregate(slice({lens}, (i div 256) * 256 + 1, i % 256 + 1), 0, (s, x) -> s + x)"
    spans = f"""transform({bodies}, (body, i) -> named_struct('kind', {kind},
        'start', cast({end} - length(body) as int), 'stop', cast({end} as int), 'body', body,
        'before', lower(substring({gaps}[i], greatest(length({gaps}[i]) - {CONTEXT - 1}, 1), {CONTEXT}))))"""
    return df.withColumn(name, F.expr(spans)).drop(lens, sums, gaps, bodies)


def digits(body: str) -> str:
    return f"regexp_replace({body}, '[^0-9]', '')"


def luhn(body: str) -> str:
    """SQL: whether the digits of ``body`` pass Luhn's test."""
    d = digits(body)
    at = f"cast(substring({d}, length({d}) - i, 1) as int)"
    weighed = f"CASE WHEN i % 2 = 0 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END"
    return f"(aggregate(transform(sequence(0, length({d}) - 1), i -> {weighed}), 0, (s, x) -> s + x) % 10 = 0)"


def parts_fit(body: str) -> str:
    """SQL: whether every dotted part is at most 255."""
    return f"forall(split({body}, '\\\\.'), p -> length(ltrim('0', p)) < 4 AND coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"


def passes(kind: str, body: str) -> str:
    n = f"length({digits(body)})"
    return {
        "email": "true",
        "ip": parts_fit(body),
        "card": f"(CASE WHEN {n} BETWEEN 16 AND 19 THEN {luhn(body)} ELSE false END)",
        "phone": f"({n} BETWEEN 8 AND 15)",
    }[kind]


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_base``: the base spans of all kinds, by kind, then start. ``text`` is not null."""
    names = []
    for number, kind in enumerate(KINDS):
        name = f"_base_{kind}"
        gaps, bodies = matches(F.col(text), BASE[kind], HINT[kind](F.col(text)))
        docs = docs.withColumn(f"{name}_g", gaps).withColumn(f"{name}_b", bodies)
        docs = positioned(docs, name, number, f"{name}_g", f"{name}_b")
        docs = docs.withColumn(name, F.expr(f"filter({name}, s -> {passes(kind, 's.body')})"))
        names.append(name)
    return docs.withColumn("_base", F.concat(*names)).drop(*names)


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_cands``: candidate spans with features ``f`` and rule label ``y``."""
    names = []
    for kind, (pattern, hint) in GENERATORS.items():
        name = f"_cand_{kind}"
        gaps, bodies = matches(F.col(text), pattern, hint(F.col(text)))
        docs = docs.withColumn(f"{name}_g", gaps).withColumn(f"{name}_b", bodies)
        number = KINDS.index(kind) if kind in KINDS else KINDS.index("phone")
        docs = positioned(docs, name, number, f"{name}_g", f"{name}_b")
        names.append(name)
    card = KINDS.index("card")
    docs = docs.withColumn("_also", F.expr(f"transform(_cand_digits, s -> named_struct('kind', {card}, 'start', s.start, 'stop', s.stop, 'body', s.body, 'before', s.before))"))
    docs = docs.withColumn("_cands", F.concat(*names, "_also")).drop(*names, "_also")
    return docs.withColumn("_cands", F.expr(f"transform(_cands, c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop, 'f', {features()}, 'y', {rule_label()}))"))


#: Context words of each kind. Fixed values of the feature set.
_CONTEXT_WORDS = {"email": "mail|contact|write|schreib", "ip": "ip|host|server|addr", "card": "card|visa|credit|konto|carte", "phone": "tel|phone|fon|call|fax|mobil"}


def features(c: str = "c") -> str:
    """SQL array of doubles: format of the body, then what stands before it."""
    body, before, d = f"{c}.body", f"{c}.before", digits(f"{c}.body")
    groups = f"regexp_count({body}, '[0-9]+')"
    out = [f"{c}.kind = {i}" for i in range(len(KINDS))]
    out += [
        f"length({body})", f"length({d})", f"length({d}) / length({body})", groups, f"length({d}) / greatest({groups}, 1)",
        f"regexp_count({body}, '[.]')", f"regexp_count({body}, '[- ]')", f"regexp_count({body}, '[(]')",
        f"CASE WHEN length({d}) > 12 THEN {luhn(body)} ELSE false END", f"{body} rlike '^0'",
        f"CASE WHEN {c}.kind = {KINDS.index('ip')} THEN {parts_fit(body)} ELSE true END",
        f"{body} rlike '[.][A-Za-z]{{2,6}}$'", f"{before} rlike '[a-z0-9]$'", f"{before} rlike ' $'", f"{before} rlike '[-.:=\"#_/]$'",
    ]
    out += [f"{before} rlike '(?:{w})'" for w in _CONTEXT_WORDS.values()]
    return "array(" + ", ".join(f"cast({x} as double)" for x in out) + ")"


def rule_label(c: str = "c") -> str:
    """SQL: 1.0 a base span, 0.0 none of its kind, null undecided."""
    body, n = f"{c}.body", f"length({digits(c + '.body')})"
    same = f"exists(_base, b -> b.kind = {c}.kind AND b.start = {c}.start AND b.stop = {c}.stop)"
    ip, card, phone = (KINDS.index(k) for k in ("ip", "card", "phone"))
    never = f"""CASE {c}.kind
        WHEN {ip} THEN NOT ({parts_fit(body)}) OR regexp_count({body}, '[.]') <> 3
        WHEN {card} THEN {n} < 13 OR {n} > 19 OR NOT ({luhn(body)})
        WHEN {phone} THEN {n} < 8 OR {n} > 15 OR {body} rlike '^[0-9]+$' OR {body} rlike '^[0-9]{{4}}[-.][0-9]{{2}}[-.][0-9]{{2}}'
            OR {body} rlike '^[0-9.]+$'
        ELSE false END"""
    return f"CASE WHEN {same} THEN 1D WHEN {never} THEN 0D END"


def tree_sql(node, array: str) -> str:
    """A tree of the fitted model as nested CASE expressions over the feature array."""
    if node.numDescendants() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    left, right = tree_sql(node.leftChild(), array), tree_sql(node.rightChild(), array)
    return f"CASE WHEN {array}[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {left} ELSE {right} END"


def fit(found: DataFrame, key: str, sample: int = SAMPLE) -> tuple[str, list[float]] | None:
    """SQL of a candidate's probability (over ``c.f``) and the threshold of each kind; None where
    candidates of both labels are missing. ``found`` has ``_cands``."""
    rows = found.where(F.size("_cands") > 0).select(F.col(key).alias("id"), F.explode("_cands").alias("c"))
    rows = cut(rows.where("c.y is not null").select("id", "c.start", "c.kind", "c.f", "c.y"))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    n = rows.count()
    spot = F.pmod(F.xxhash64("id", "start", "kind"), F.lit(1 << 30))
    chosen = rows.where(~held & (spot < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))))
    train = chosen.select(array_to_vector("f").alias("features"), F.col("y").alias("label"))
    if train.select("label").distinct().count() < 2:
        return None
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32)
    model = gbt.fit(train.coalesce(8))  # bounded by SAMPLE
    weights = model.treeWeights
    margin = " + ".join(f"{w!r}D * ({tree_sql(t._call_java('rootNode'), 'c.f')})" for w, t in zip(weights, model.trees))
    probability = f"(1D / (1D + exp(-2D * ({margin}))))"
    scored = model.transform(rows.where(held).select("kind", "y", array_to_vector("f").alias("features")))
    p = vector_to_array("probability")[1]
    bins = scored.select("kind", "y", F.floor(p * 100).cast("int").alias("bin")).groupBy("kind", "bin").agg(
        F.sum("y").alias("good"), F.count("*").alias("n")
    )
    counts: dict[int, list] = {}
    for r in bins.collect():  # at most 101 bins for each kind
        counts.setdefault(r["kind"], []).append((r["bin"], r["good"], r["n"]))
    thresholds = []
    for kind in range(len(KINDS)):
        best, good, n = 2.0, 0.0, 0
        for b, g, m in sorted(counts.get(kind, []), reverse=True):
            good, n = good + g, n + m
            if b >= 50 and good / n >= PRECISION:
                best = b / 100
        thresholds.append(best)
    return probability, thresholds


def with_spans(found: DataFrame, model: tuple[str, list[float]] | None) -> DataFrame:
    """Adds ``_spans``: base and added spans (kind, start, stop), by kind, then start."""
    plain = "transform(_base, b -> named_struct('kind', b.kind, 'start', b.start, 'stop', b.stop))"
    if model is None:
        return found.withColumn("_spans", F.expr(plain))
    probability, thresholds = model
    least = "array(" + ", ".join(f"{t!r}D" for t in thresholds) + ")"
    found = found.withColumn("_scored", F.expr(f"transform(_cands, c -> named_struct('p', {probability}, 'kind', c.kind, 'start', c.start, 'stop', c.stop))"))
    picked = f"""filter(_scored, c -> c.p >= {least}[c.kind]
        AND NOT exists(_base, b -> b.start < c.stop AND c.start < b.stop))"""
    found = found.withColumn("_picked", F.expr(picked))
    better = "(o.p > c.p OR (o.p = c.p AND (o.start < c.start OR (o.start = c.start AND o.kind < c.kind))))"
    found = found.withColumn("_picked", F.expr(f"filter(_picked, c -> NOT exists(_picked, o -> o.start < c.stop AND c.start < o.stop AND {better}))"))
    added = "transform(_picked, c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop))"
    return found.withColumn("_spans", F.array_sort(F.expr(f"concat({plain}, {added})"))).drop("_scored", "_picked")


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.array_join(F.expr(f"transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.stop))"), ",")


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _base, _cands) of every row, cut from lineage: the only scan of the texts."""
    base = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    return with_candidates(with_base(base, "_text"), "_text").drop("_text")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row."""
    found = cut(candidates(docs, key, text))
    spans = with_spans(found, fit(found, key))
    counts = [F.expr(f"cast(size(filter(_base, b -> b.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.select(
        key, *counts, F.sha2(listed("_base").cast("binary"), 256).alias("base_sha256"), listed("_spans").alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("bigint").alias("n_added"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; other columns unchanged."""
    slim = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body"))
    model = fit(cut(candidates(slim, "_key", "_body")), "_key")
    # the caller's columns ride in one struct, so that no name of theirs meets one of the work columns
    ready = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    ready = with_spans(with_candidates(with_base(ready, "_text"), "_text"), model)
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    ready = ready.withColumn("_spans", by_start)
    tags = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    seen = "coalesce(array_max(transform(slice(_spans, 1, i), o -> o.stop)), 0)"
    piece = f"""transform(_spans, (s, i) -> CASE WHEN s.start >= {seen}
        THEN concat(substring(_text, {seen} + 1, s.start - {seen}), {tags}[s.kind]) ELSE '' END)"""
    tail = "substring(_text, coalesce(array_max(transform(_spans, o -> o.stop)), 0) + 1)"
    clean = F.when(F.size("_spans") == 0, F.col(f"_row.`{text}`")).otherwise(F.concat(F.array_join(F.expr(piece), ""), F.expr(tail)))
    return ready.select(*[clean.alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
