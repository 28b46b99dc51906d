"""Queries of the text operators, and the SQL of those that SQL can express."""

from quire.llm import leakage, lookalikes, markup, packing, personal, quality, repetition, scans, splitting


def queries():
    return {
        "p1_found": repetition.found,
        "p1_stats": repetition.stats,
        "p2_found": quality.found,
        "p2_stats": quality.stats,
        "p2_labels": quality.labels,
        "p3_found": markup.found,
        "p3_clean": markup.clean,
        "p4_found": lookalikes.found,
        "p4_tokens": lookalikes.tokens,
        "p4_clean": lookalikes.clean,
        "p5_found": scans.found,
        "p5_repair": scans.repair,
        "p6_found": splitting.found,
        "p6_pieces": splitting.pieces,
        "p7_packing": packing.packing,
        "p8_found": leakage.found,
        "p8_shares": leakage.pairs,
        "p9_found": personal.found,
        "p9_redacted": personal.redact,
    }


def oracle_sql():
    return {"p6_found": splitting.FOUND_SQL}
