"""Licence notices in texts: an exact set-similarity join of text blocks with templates.

Template words are ordered by how often they occur in all texts, rare ones first. A block that
holds the wanted share of a template's words must hold one of the template's first few, so blocks
meet templates on those words only; what the block's size and the places of the shared word leave
open decides whether the words are compared in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage

#: Share of a template's distinct words a block must hold.
CONTAINED = 0.8
#: Usual short notices by label (fixed values).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
]
#: Base phrases by label (fixed values).
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of text that is not lower-cased yet, and what ends one.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Blocks are lines, cut once more where a sentence ends, and sentences that run on over single line breaks.
SENTENCE_END = "([.!?])[\\t\\f\\r ]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def blocks_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")


def wrapped_of(text: Column) -> Column:
    """Sentences of several lines, cut at blank lines and sentence ends."""
    return F.filter(F.split(F.regexp_replace(text, SENTENCE_END, "$1\n\n"), "\\n[\\t\\f\\r ]*\\n|(?<=[.!?])\\n"), lambda b: b.contains("\n"))


def _most(words: Column, width: Column, wanted: Column) -> Column:
    """Most distinct wanted words within any run of ``width`` words."""
    def at(taken):
        return F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(taken) - width + 1, F.lit(1))), lambda i: F.size(F.array_intersect(F.slice(taken, i, width), wanted))))

    return F.get(F.transform(F.array(words), at), F.lit(0))  # the outer lambda holds the words


def _anywhere(phrases: list[str]) -> str:
    """Pattern of whole words or phrases whose words stand consecutively; only A-Z match either case."""
    alternatives = "|".join(f"{GAP}+".join(p.split()) for p in phrases)
    return f"(?i)(?<!{WORD[:-1]})(?:{alternatives})(?!{WORD[:-1]})"


def base_columns(text: Column, phrases: list[tuple[str, str]] = PHRASES) -> dict[str, Column]:
    """Count of words, of places of phrases, their first and last word, and their labels, row by row."""
    hits = text.rlike(_anywhere([p for _, p in phrases]))

    def standing(words):
        def at(i):
            found = F.lit(False)
            for _, phrase in phrases:
                one = F.lit(True)
                for k, word in enumerate(phrase.split()):
                    one = one & (F.get(words, i + k) == word)
                found = found | F.coalesce(one, F.lit(False))
            return found

        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at)

    # only texts with a hit are taken apart, each once: the outer lambda holds its words
    taken = F.get(F.transform(F.array(words_of(text)), standing), F.lit(0))
    places = F.when(hits, taken).otherwise(F.array().cast("array<int>"))
    labels = F.filter(F.array(*[F.when(text.rlike(_anywhere([p])), F.lit(label)) for label, p in phrases]), lambda x: x.isNotNull())
    return {"n_words": F.regexp_count(text, F.lit(WORD)).cast("long"), "places": places, "base": F.when(hits, labels).otherwise(F.array().cast("array<string>"))}


def notices(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, share: float = CONTAINED) -> DataFrame:
    """(doc_id, labels, score): labels of templates of which some block holds the share, and the best share.

    In a block of several lines the words must stand within a run of the template's length and as
    much more as the share leaves open. Documents without such a block give no row.
    """
    sets = [sorted(set(text.replace(".", " ").split())) for _, text in templates]
    vocabulary = sorted(set().union(*sets))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    counted = (texts.select(F.explode(F.regexp_extract_all("text", F.lit(_anywhere(vocabulary)), F.lit(0))).alias("w"))
               .groupBy(F.translate("w", UPPER, LOWER).alias("w")).agg(F.count(F.lit(1)).alias("c")).collect())  # a row for each template word at most
    count = {r["w"]: r["c"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    sets = [sorted(s, key=rank.__getitem__) for s in sets]
    widths = [math.ceil(len(text.replace(".", " ").split()) / share - 1e-9) for _, text in templates]
    need = [math.ceil(share * len(s) - 1e-9) for s in sets]
    heads = [s[:len(s) - c + 1] for s, c in zip(sets, need, strict=True)]
    first = sorted(set().union(*heads), key=rank.__getitem__)
    index = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("template"), F.lit(i).alias("t_pos"), F.lit(len(sets[t])).alias("size"), F.lit(need[t]).alias("need"), F.lit(widths[t]).alias("width"))
                                for t, head in enumerate(heads) for i, w in enumerate(head)])).alias("x")
    heads_table = docs.sparkSession.range(1).select(index).select("x.*")
    ordered = F.array(*[F.lit(w) for w in order])
    block = (texts.where(F.col("text").rlike(_anywhere(first)))
             .select("doc_id", F.posexplode(F.concat(blocks_of(F.col("text")), wrapped_of(F.col("text")))).alias("no", "block")).where(F.col("block").rlike(_anywhere(first)))
             .select("doc_id", "no", F.array_intersect(ordered, words_of(F.col("block"))).alias("held"), F.when(F.col("block").contains("\n"), F.col("block")).alias("wrapped")))  # in the global order
    met = (block.where(F.size("held") >= min(need)).select("doc_id", "no", "held", "wrapped", F.posexplode("held").alias("b_pos", "w"))
           .join(heads_table, "w")
           .where("size(held) >= need and 1 + least(size - t_pos, size(held) - b_pos) - 1 >= need")
           .select("doc_id", "no", "held", "wrapped", "template", "size", "need", "width").distinct())
    texts_of = F.array(*[F.array(*[F.lit(w) for w in s]) for s in sets])
    names = F.array(*[F.lit(label) for label, _ in templates])
    wanted = F.element_at(texts_of, F.col("template") + 1)
    shared = F.when(F.col("wrapped").isNull(), F.size(F.array_intersect("held", wanted))).otherwise(_most(words_of(F.col("wrapped")), F.col("width"), wanted))
    return (met.withColumn("shared", shared).where("shared >= need")
            .groupBy("doc_id").agg(F.collect_set(F.element_at(names, F.col("template") + 1)).alias("found"), F.max(F.col("shared") / F.col("size")).alias("best")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    A null text counts as empty: no words, no places, empty labels, score 0. Rows that share a
    doc_id share what the join finds; rows with a null doc_id have their base labels only. The score
    is 1 where a base phrase stands, else the best share found (0 if none reaches the threshold).
    """
    cols = base_columns(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", *[c.alias(k) for k, c in cols.items()])
    found = cut_lineage(notices(docs))
    joined = base.join(found, "doc_id", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
