"""Queries and DuckDB oracles of the training-data operators."""

from veilspan.llm import ann, bpe, chat, langid, merkle, mixing, neardup, quality, secrets, spelling, sql, substring, urlfilter, warc

QUERIES = {
    f.__name__: f
    for f in (
        langid.op1_language_id,
        neardup.op2_minhash_near_dedup,
        substring.op3_substring_dedup,
        secrets.op4_secret_scans,
        bpe.op5_bpe,
        ann.op7_nearest_neighbours,
        quality.op6_quality_rules,
        chat.op8_chat_formatting,
        urlfilter.op9_url_filters,
        mixing.op10_mixing_sources,
        merkle.op11_merkle_manifest,
        spelling.op12_spelling_variants,
        warc.op13_warc,
    )
}
ORACLES: dict[str, str] = {
    "op3_substring_dedup": sql.SUBSTRING,
    "op6_quality_rules": sql.QUALITY.format(
        line_docs=quality.LINE_DOCS, line_share=quality.LINE_SHARE, min_words=quality.MIN_WORDS, max_repeat=quality.MAX_REPEAT_PERCENT, depleted=quality.DEPLETED
    ),
    "op8_chat_formatting": sql.CHAT,
    "op10_mixing_sources": sql.mixing(*mixing.whole_units(mixing.WEIGHTS, mixing.DEFAULT), mixing.BLOCK_DOCS),
    "op11_merkle_manifest": sql.MERKLE,
    "op12_spelling_variants": sql.SPELLING,
    "op13_warc": sql.WARC,
}
