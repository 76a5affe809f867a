"""Queries of this subpackage, and their SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table


def tokenizer_file() -> str:
    """The vocabulary of the token output."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_ann(spark, sf_dir):
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark, sf_dir):
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_rans(spark, sf_dir):
    from .rans import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_file(), slice_bytes=16 << 20)


#: Target shares of tokens by quality.
WEIGHTS = {"high": 0.9, "low": 0.1}

#: Those of the query of its own: far from what the documents hold.
TARGETS = {"high": 0.6, "low": 0.4}


def quality_domains(spark, sf_dir):
    """``doc_id, domain`` of the labelled table."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") > 0, "high").when(F.col("quality") <= 0, "low").alias("domain"))


def op1_warc(spark, sf_dir):
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark, sf_dir):
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), least_chars=1)  # every line that is not empty


def op3_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixture(spark, sf_dir):
    from .mixture import mixture

    return mixture(table(spark, sf_dir, "documents"), quality_domains(spark, sf_dir), TARGETS)


def op11_release(spark, sf_dir):
    from .release import replay

    return replay(table(spark, sf_dir, "conversations"))


def op12_manifest(spark, sf_dir):
    from .manifest import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op13_quality(spark, sf_dir):
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries():
    return {"op1_warc": op1_warc, "op2_line_dedup": op2_line_dedup, "op3_suffix_dedup": op3_suffix_dedup, "op4_toxicity": op4_toxicity, "op5_ann": op5_ann, "op6_decontaminate": op6_decontaminate, "op7_substring_dedup": op7_substring_dedup, "op8_jaccard_join": op8_jaccard_join, "op9_rans": op9_rans, "op10_mixture": op10_mixture, "op11_release": op11_release, "op12_manifest": op12_manifest, "op13_quality": op13_quality}


def oracle_sql():
    from . import jaccard_join, manifest, release, suffix_dedup, warc

    return {"op1_warc": warc.SQL, "op3_suffix_dedup": suffix_dedup.SQL, "op8_jaccard_join": jaccard_join.SQL, "op11_release": release.SQL, "op12_manifest": manifest.SQL}
