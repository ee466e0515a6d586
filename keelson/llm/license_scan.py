"""License scan by diagonal voting, with DataFrame functions only.

The words of every text are cut into rolling 3-grams, whose hashes are joined with the gram positions of fixed license
templates (a broadcast table of a few hundred rows, whatever the corpus) and compared word by word. A hit votes for the
diagonal `text position - template position`; votes are summed before the shuffle as a bit mask of template positions.
Neighbouring diagonals of a template are merged, so that an inserted or missing word does not split a span; a span is verified
gram by gram and counts if it covers enough of the template. A phrase stands in full at a place exactly where its diagonal has all its grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lower_ascii

K = 3
BLOCK = 8_192
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases that name a license in full.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Well-known sentences of license texts and notices, at most 63 grams each.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
)


def words(text: Column) -> Column:
    """Lower-cased words: runs of digits, ASCII letters and all characters beyond ASCII. Null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def template_grams(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per template gram: the fixed side of the join."""
    rows = [(True, p) for p in phrases] + [(False, n) for n in notices]
    texts = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_l_template"), F.lit(label).alias("_l_label"), F.lit(base).alias("_l_base"), F.split(F.lit(text), " ").alias("w"))
        for i, (base, (label, text)) in enumerate(rows)])))
    grams = texts.withColumn("_l_grams", F.size("w") - K + 1).select("*", F.explode(F.sequence(F.lit(0), F.size("w") - K)).alias("_l_at"))
    word = [F.get("w", F.col("_l_at") + i).alias(f"_l_w{i}") for i in range(K)]
    return grams.select("_l_template", "_l_label", "_l_base", "_l_grams", "_l_at", *word, F.xxhash64(*word).alias("_l_hash"),
                        F.expr("shiftleft(1L, _l_at)").alias("_l_bit"))


def gram_places(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier, text hash and word count of a document with `_l_pos` and the words of every gram, and one row at place -1.

    A text is first cut into blocks of BLOCK words, so that no row carries more than a block.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("_l_id"), F.xxhash64(text).alias("_l_text"), words(text).alias("w")).withColumn("_l_n", F.size("w"))
    starts = F.when(F.col("_l_n") >= K, F.sequence(F.lit(0), F.col("_l_n") - K, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    whole = F.transform(F.concat(F.array(F.lit(-1)), starts), lambda s: F.struct(
        s.alias("at"), F.when(s >= 0, F.slice("w", F.greatest(s, F.lit(0)) + 1, BLOCK + K - 1)).alias("w")))
    blocks = docs.select("_l_id", "_l_text", "_l_n", F.explode(whole).alias("b")).select("_l_id", "_l_text", "_l_n", "b.at", "b.w")

    def gram(i, at):
        return F.struct((at + i).alias("_l_pos"), *[F.get("w", i + k).alias(f"_l_g{k}") for k in range(K)])

    grams = F.when(F.col("at") >= 0, F.transform(F.sequence(F.lit(0), F.size("w") - K), lambda i: gram(i, F.col("at")))).otherwise(
        F.array(F.struct(F.lit(-1).alias("_l_pos"), *[F.lit(None).cast("string").alias(f"_l_g{k}") for k in range(K)])))
    return blocks.select("_l_id", "_l_text", "_l_n", F.explode(grams).alias("g")).select("_l_id", "_l_text", "_l_n", "g.*")


def diagonal_votes(df: DataFrame, id_col: str, text_col: str, grams: DataFrame) -> DataFrame:
    """One row per document, template and diagonal that got a vote, and one row per document without a template."""
    word = [F.col(f"_l_g{k}") for k in range(K)]
    places = gram_places(df, id_col, text_col).withColumn("_l_hash", F.when(F.col("_l_pos") >= 0, F.xxhash64(*word)))
    same = (word[0] == F.col("_l_w0")) & (word[1] == F.col("_l_w1")) & (word[2] == F.col("_l_w2"))
    sides = grams.select("_l_hash", "_l_template", "_l_at", "_l_bit", "_l_w0", "_l_w1", "_l_w2")
    hits = places.join(F.broadcast(sides), "_l_hash", "left").where((F.col("_l_pos") < 0) | same)
    return hits.groupBy("_l_id", "_l_text", "_l_template", (F.col("_l_pos") - F.col("_l_at")).alias("_l_diagonal")).agg(
        F.max("_l_n").alias("_l_n_words"), F.count(F.when(F.col("_l_pos") < 0, 1)).alias("_l_rows"), F.bit_or("_l_bit").alias("_l_mask"))


def license_spans(votes: DataFrame, grams: DataFrame, merge_gap: int) -> DataFrame:
    """The votes with label, kind and `coverage`: the share of the template's grams on the best verified span from a diagonal.

    A span stays on its diagonal or changes once to a neighbouring one, at most merge_gap words away: an insertion, a gap or a
    replacement. It is verified gram by gram: those before the change are on the first diagonal, those behind it on the second,
    and places ascend in template and text, so grams in another order or further apart do not add up.
    """
    near = Window.partitionBy("_l_id", "_l_text", "_l_template").orderBy("_l_diagonal").rangeBetween(-merge_gap, merge_gap)
    templates = grams.select("_l_template", "_l_label", "_l_base", "_l_grams").distinct()
    rows = votes.withColumn("_l_near", F.collect_list(F.struct(F.col("_l_diagonal").alias("d"), F.col("_l_mask").alias("m"))).over(near))
    rows = rows.join(F.broadcast(templates), "_l_template", "left")
    own, all_bits = F.col("_l_mask"), F.lit(-1).cast("bigint")

    def behind(at):         # the bits from a place of the template on
        return F.when(at < 63, F.call_function("shiftleft", all_bits, F.least(at, F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("bigint"))

    def with_other(other):
        shift = F.greatest(F.col("_l_diagonal") - other["d"], F.lit(0)).cast("int")
        split = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_l_grams"), F.lit(1))), lambda t: F.bit_count(
            own.bitwiseAND(F.bitwise_not(behind(t)))) + F.bit_count(other["m"].bitwiseAND(behind(t + shift))))
        return F.array_max(split)

    best = F.when(F.size("_l_near") > 1, F.array_max(F.transform(F.filter("_l_near", lambda o: o["d"] != F.col("_l_diagonal")), with_other)))
    found = F.greatest(F.bit_count(own), F.coalesce(best, F.lit(0)))
    return rows.withColumn("coverage", F.coalesce(found / F.col("_l_grams"), F.lit(0.0)))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_coverage: float = 0.8, merge_gap: int = 3,
                 phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per input row: identifier, word count, the places of the phrases, labels and the best coverage as `score`.

    `base_labels` are those of phrases that stand in full, `labels` add templates of which a verified span covers at least
    `least_coverage` of the grams; both are sorted and comma-joined, empty if there are none. Null text equals empty text:
    no words, no labels, score 0. Rows with a null identifier, and rows that repeat identifier and text, each give their own
    row. Other columns of the input are not read. An empty table gives an empty result. Time and memory grow with a text's length.
    """
    grams = template_grams(df.sparkSession, phrases, notices)
    spans = license_spans(diagonal_votes(df, id_col, text_col, grams), grams, merge_gap)
    # a phrase stands in full where every one of its grams is on one diagonal
    place = F.col("_l_base") & (F.bit_count("_l_mask") == F.col("_l_grams"))

    def joined(condition):
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("_l_label")))), ",")

    found = spans.groupBy("_l_id", "_l_text").agg(
        F.max("_l_n_words").cast("bigint").alias("n_words"), F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("_l_diagonal"))).cast("bigint").alias("first_word"),
        F.max(F.when(place, F.col("_l_diagonal"))).cast("bigint").alias("last_word"),
        joined(place).alias("base_labels"), joined(place | (F.col("coverage") >= least_coverage)).alias("labels"),
        F.max("coverage").alias("score"), F.max("_l_rows").alias("_l_rows"))
    return found.select(F.col("_l_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                        F.explode(F.array_repeat(F.lit(0), F.col("_l_rows").cast("int"))).alias("_l_copy")).drop("_l_copy")
