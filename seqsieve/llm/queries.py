"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe, fingerprints, langid, mixing, ppm, ranked, sentence_pieces, simhash, substrings, tiff, token_counts, url_filter, whitening

QUERIES = {
    "op1_ppm": ppm.op1_ppm,
    "op2_bpe": bpe.op2_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_tiff": tiff.op4_tiff,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_substrings": substrings.op6_substrings,
    "op7_langid": langid.op7_langid,
    "op8_simhash": simhash.op8_simhash,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_whitening": whitening.op11_whitening,
    "op12_sentence_pieces": sentence_pieces.op12_sentence_pieces,
    "op13_ranked_search": ranked.op13_ranked_search,
}
SQL = {"op9_url_filter": url_filter.SQL, "op10_token_counts": token_counts.SQL, "op13_ranked_search": ranked.SQL}
