"""License scans: ordered signature rules behind a keyword gate, DataFrame functions only.

Words are runs of ASCII letters (A-Z lowered), digits and non-ASCII characters. Each rule's pattern runs only on texts
that hold its keyword as a word; a detection inside another of higher priority (or of equal priority and longer) is
suppressed. Null or empty text: no words, no detections, score 0. Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import texts
from .license_rules import RULES

#: Fixed values of the contract: phrase, label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Items between two appends to the whole result of a sweep.
PART = 128


def quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'"


RANKS = sorted({rank for _, _, rank, _ in RULES})


def swept(items: str, start: str, state: str, value: str, kind: str) -> str:
    """SQL: value(z, x) of each item x, where z goes from `start` by state(z, x); in parts, so that appending stays cheap."""
    none = f"cast(array() as array<{kind}>)"
    inner = f"aggregate(part, struct(t.z as z, {none} as out), (u, x) -> transform(array(u.z), z -> struct({state} as z, concat(u.out, array({value})) as out))[0])"
    parts = f"transform(array({items}), a -> transform(sequence(0, size(a) div {PART}), p -> slice(a, p * {PART} + 1, {PART})))[0]"
    return f"aggregate({parts}, struct({start} as z, {none} as out), (t, part) -> transform(array({inner}), i -> struct(i.z as z, concat(t.out, i.out) as out))[0], t -> t.out)"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; detections (label, start, end) as words."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = texts(docs).select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" ")).alias("norm"))
    df = df.withColumn("n_words", F.when(F.length("norm") <= 2, F.lit(0)).otherwise(F.length("norm") - F.length(F.expr("replace(norm, ' ', '')")) - 1).cast("long"))
    hits = []
    for phrase, label in BASE:
        p = phrase.split(" ")
        test = " and ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(p))
        hits.append(f"if(contains(norm, ' {phrase} '), transform(filter(sequence(0, size(words) - 1), i -> {test}), i -> named_struct('at', cast(i as bigint), 'label', '{label}')), array())")
    df = df.withColumn("words", F.split(F.trim("norm"), " ")).withColumn("base", F.expr(f"concat({', '.join(hits)})"))
    by_word = {}
    for label, word, rank, pattern in RULES:
        by_word.setdefault(word, []).append(f"named_struct('label', {quoted(label)}, 'rank', {rank}, 'pattern', {quoted(f' (?:{pattern})(?= )')})")
    # One pass over a text's words finds its keywords; the map gives their rules.
    keywords = "array(" + ", ".join(f"'{word}'" for word in by_word) + ")"
    table = "map(" + ", ".join(f"'{word}', array({', '.join(rules)})" for word, rules in by_word.items()) + ")"
    # Start and end characters of every hit of a rule, from the pieces between hits.
    pieces = "transform(array(regexp_extract_all(norm, r.pattern, 0)), m -> zip_with(slice(split(norm, r.pattern, -1), 1, size(m)), m, (a, b) -> struct(length(a) as gap, length(b) as long)))[0]"
    place = swept(pieces, "0", "z + x.gap + x.long", "struct(z + x.gap as s, z + x.gap + x.long as e)", "struct<s:int,e:int>")
    gated = f"filter(flatten(transform(array_intersect(words, {keywords}), w -> element_at({table}, w))), r -> norm rlike r.pattern)"
    spans = f"flatten(transform({gated}, r -> transform({place}, h -> named_struct('s', h.s, 'e', h.e, 'rank', r.rank, 'label', r.label))))"
    df = df.withColumn("found", F.expr(spans))
    # One sweep over hits by start, longest and highest first. z[k]: the furthest end so far of rank RANKS[k], and where
    # the last span of that end began. A hit ends within an earlier one of higher rank, or a longer one of its own: suppressed.
    ordered = "transform(array_sort(transform(found, x -> struct(x.s as s, -x.e as e, -x.rank as rank, x.label as label))), x -> struct(x.s as s, -x.e as e, -x.rank as rank, x.label as label))"
    inside = " or ".join(f"(x.rank < {r} and z[{k}].e >= x.e) or (x.rank = {r} and (z[{k}].e > x.e or z[{k}].e = x.e and z[{k}].s < x.s))" for k, r in enumerate(RANKS))
    step = "array(" + ", ".join(f"if(x.rank = {r} and x.e > z[{k}].e, struct(x.e as e, x.s as s), z[{k}])" for k, r in enumerate(RANKS)) + ")"
    sweep = swept(ordered, "array_repeat(struct(-1 as e, -1 as s), %d)" % len(RANKS), step, f"struct(x.s as s, x.e as e, x.label as label, ({inside}) as gone)", "struct<s:int,e:int,label:string,gone:boolean>")
    df = df.withColumn("kept", F.expr(f"filter({sweep}, x -> not x.gone)"))
    names = lambda e: F.array_join(F.array_sort(F.array_distinct(F.expr(e))), ",")
    return df.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.expr("array_min(transform(base, x -> x.at))").alias("first_word"), F.expr("array_max(transform(base, x -> x.at))").alias("last_word"),
        names("transform(base, x -> x.label)").alias("base_labels"), names("concat(transform(base, x -> x.label), transform(kept, x -> x.label))").alias("labels"),
        F.expr("if(size(base) + size(kept) = 0, 0d, 1d - pow(0.5d, size(base) + size(kept)))").alias("score"),
        F.expr("array_sort(transform(kept, x -> named_struct('s', x.s, 'e', x.e, 'label', x.label)))").alias("detections"),
    )
