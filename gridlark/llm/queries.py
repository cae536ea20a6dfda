"""The queries that apply each operator to its whole table."""

from __future__ import annotations

from gridlark.llm import alignment, bpe, decontaminate, filter_audit, html_text, line_dedup, mpeg_audio, ngram_join, quality, secret_scan, simhash, toxicity, url_templates
from gridlark.llm.common import table


def op1_mpeg_audio(spark, sf_dir):
    return mpeg_audio.media_digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents"))


def op3_html_text(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.classes(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_templates(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_alignment(spark, sf_dir):
    return alignment.link_scores(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mpeg_audio": op1_mpeg_audio,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_url_templates": op10_url_templates,
    "op11_filter_audit": op11_filter_audit,
    "op12_alignment": op12_alignment,
    "op13_ngram_join": op13_ngram_join,
}

ORACLES = {"op5_secret_scan": secret_scan.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op13_ngram_join": ngram_join.ORACLE}
