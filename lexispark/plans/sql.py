"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.text import ALPHABET, BARE, SPECIAL, TONES, VOWELS
from ..operators.candidates import DIGRAPHS, TONE_KEYS, rule_rows
from ..operators.phonology import onset_rows, rime_rows


def _values(rows) -> str:
    show = lambda x: ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


_toned = "".join(f for forms in TONES.values() for f in forms[1:])
_untoned = "".join(b for b, forms in TONES.items() for _ in forms[1:])
_marked = "".join(f for b, forms in TONES.items() for f in forms if f != BARE.get(b, b)) + "đ"
_plain = "".join(BARE.get(b, b) for b, forms in TONES.items() for f in forms if f != BARE.get(b, b)) + "d"

DIMENSIONS = f"""
    onsets(k, onset, class) AS ({_values(onset_rows())}),
    rimes(rime, q_only) AS ({_values(rime_rows())}),
    vowels(vowel, tone, toned) AS ({_values([(b, k, f) for b, forms in TONES.items() for k, f in enumerate(forms)])}),
    clusters AS (SELECT *, regexp_extract(rime, '^[{VOWELS}]+') AS cl FROM rimes),
    placed AS (
        SELECT rime, q_only, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS placement FROM (
            SELECT *, CASE WHEN instr(cl, 'ê') > 0 THEN [instr(cl, 'ê')] WHEN instr(cl, 'ơ') > 0 THEN [instr(cl, 'ơ')]
                WHEN length(rime) > length(cl) THEN [length(cl)] WHEN rime IN ('oa', 'oe', 'uy') THEN [1, 2] WHEN length(cl) <= 2 THEN [1] ELSE [2] END AS ps FROM clusters)
    ),
    toned AS (
        SELECT rime, q_only, tone, placement, substr(rime, 1, p - 1) || toned || substr(rime, p + 1) AS form FROM placed JOIN vowels ON vowel = substr(rime, p, 1)
        WHERE NOT regexp_matches(rime, '(ch|c|p|t)$') OR tone IN (2, 5)
    ),
    compositions AS (
        SELECT '' AS onset, rime, tone, placement, form AS syllable FROM toned
        UNION ALL
        SELECT onset, rime, tone, placement, CASE WHEN suffix(onset, substr(rime, 1, 1)) THEN substr(onset, 1, length(onset) - 1) ELSE onset END || form FROM toned JOIN onsets
        ON (class = 'A' OR (class = 'F') = (substr(rime, 1, 1) IN ('e', 'ê', 'i', 'y'))) AND (NOT q_only OR onset = 'qu')
    ),
    valid AS (SELECT DISTINCT syllable FROM compositions)
"""
LINES = f"""
    lines AS (
        SELECT * FROM (
            SELECT doc_id, unnest(range(len(l))) AS line, unnest(list_transform(l, lambda x: regexp_extract_all(lower(nfc_normalize(x)), '[{ALPHABET}]+'))) AS words
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
        ) WHERE len(words) > 0
    ),
    words AS (SELECT doc_id, line, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM lines),
    unis AS (SELECT w AS token, count(*) AS count, count(DISTINCT (doc_id, line)) AS spread FROM words GROUP BY w),
    grams AS (SELECT *, lead(w) OVER l AS b, lead(w, 2) OVER l AS c FROM words WINDOW l AS (PARTITION BY doc_id, line ORDER BY pos))
"""
_TWOS = "twos AS (SELECT w AS a, b, count(*) AS count FROM grams WHERE b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 8)"
_THREES = "threes AS (SELECT w AS a, b, c, count(*) AS count FROM grams JOIN twos t ON t.a = w AND t.b = grams.b WHERE c IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 6)"
_THREES = _THREES.replace("SELECT w AS a, b, c,", "SELECT w AS a, grams.b AS b, c,")
_SCORES = f"""
    {_TWOS}, {_THREES},
    ctx AS (SELECT doc_id, line, pos, w, lag(w, 2) OVER l AS a, lag(w) OVER l AS b FROM words WINDOW l AS (PARTITION BY doc_id, line ORDER BY pos)),
    total AS (SELECT CAST(sum(count) AS DOUBLE) AS n FROM unis),
    scores AS (
        SELECT ctx.doc_id, line, pos, ln(greatest(1e-9, CASE
            WHEN ctx.a IS NOT NULL AND t3.count > 0 AND ab.count > 0 THEN t3.count / CAST(ab.count AS DOUBLE)
            WHEN ctx.b IS NOT NULL AND bw.count > 0 THEN CASE WHEN ctx.a IS NOT NULL THEN 0.4 ELSE 1.0 END * bw.count / ub.count
            ELSE pow(0.4, (ctx.a IS NOT NULL)::INT + (ctx.b IS NOT NULL)::INT) * uw.count / total.n END)) AS s
        FROM ctx CROSS JOIN total JOIN unis uw ON uw.token = ctx.w LEFT JOIN unis ub ON ub.token = ctx.b
        LEFT JOIN twos bw ON bw.a = ctx.b AND bw.b = ctx.w LEFT JOIN twos ab ON ab.a = ctx.a AND ab.b = ctx.b
        LEFT JOIN threes t3 ON t3.a = ctx.a AND t3.b = ctx.b AND t3.c = ctx.w
    )
"""
_TILE = r"(?s)[\t\n\x0b\f\r\x85\pZ]+|[\pL\pM\p{Nl}0-9\x{200B}\x{200C}\x{200D}\x{2060}\x{AD}\x{FEFF}\x{180E}]+|."
_TOKENS = f"tok AS (SELECT doc_id, unnest(t) AS raw, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{_TILE}') AS t FROM documents))"
_SENTENCES = """
    parts AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?…])[\\s\\pZ]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
    clean AS (SELECT doc_id, trim(regexp_replace(s, '[\\s\\pZ]+', ' ', 'g')) AS sentence FROM parts),
    good AS (SELECT * FROM clean WHERE length(sentence) BETWEEN 40 AND 400 AND length(regexp_replace(sentence, '[^\\pL ]', '', 'g')) / CAST(length(sentence) AS DOUBLE) >= 0.9)
"""
_READINGS = """
    analyses AS (
        SELECT rime AS untoned, '' AS onset, rime FROM rimes
        UNION SELECT onset || rime, onset, rime FROM onsets, rimes
        UNION SELECT substr(onset, 1, length(onset) - 1) || rime, onset, rime FROM onsets, rimes WHERE length(onset) > 1 AND suffix(onset, substr(rime, 1, 1))
    )
"""
_tone_case = "CASE " + " ".join(f"WHEN contains('{''.join(f[k] for f in TONES.values())}', l) THEN {k}" for k in range(1, 6)) + " ELSE 0 END"


def _tone(column: str) -> str:
    return _tone_case.replace(", l)", f", nullif(regexp_extract({column}, '([{_toned}])[^{_toned}]*$', 1), ''))")


_full = "token"
for _key, _letter in DIGRAPHS:
    _full = f"replace({_full}, '{_key}', '{_letter}')"
_rules = f"rules(ord, kind, src, dst, variant) AS ({_values(rule_rows())})"

SQL: dict[str, str] = {
    "invalid_words_by_lang": f"""
        WITH {DIMENSIONS}, w AS (SELECT lang, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[{ALPHABET}]+')) AS word FROM documents)
        SELECT lang, word, count(*) AS n FROM w WHERE word NOT IN (SELECT syllable FROM valid) GROUP BY 1, 2""",
    "token_kinds": f"""
        WITH {_TOKENS}
        SELECT CASE WHEN regexp_matches(raw, '^[\\s\\pZ]') THEN 'Space' WHEN regexp_matches(raw, '[\\pL\\p{{Nl}}]') THEN 'Word' WHEN regexp_matches(raw, '[0-9]') THEN 'Number'
            WHEN regexp_matches(raw, '[\\pM\\pN\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{AD}}\\x{{FEFF}}\\x{{180E}}]') THEN 'Other' ELSE 'Punct' END AS kind, count(*) AS n, CAST(sum(strlen(raw)) AS BIGINT) AS bytes
        FROM tok GROUP BY 1""",
    "token_spans": f"""
        WITH {_TOKENS}, s AS (SELECT doc_id, pos, strlen(raw) AS n, coalesce(sum(strlen(raw)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM tok)
        SELECT doc_id, count(*) AS n, CAST(max(st + n) AS BIGINT) AS last_byte, CAST(sum(st * pos) AS BIGINT) AS weighted FROM s GROUP BY 1""",
    "sentences": f"WITH {_SENTENCES} SELECT doc_id, sentence FROM good",
    "train_split": f"WITH {_SENTENCES} SELECT CASE WHEN doc_id % 10 = 9 THEN 'held-out' ELSE 'train' END AS part, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM good GROUP BY 1",
    "syllables": f"WITH {DIMENSIONS} SELECT syllable FROM valid",
    "syllable_compose": f"WITH {DIMENSIONS} SELECT onset, rime, CAST(tone AS INTEGER) AS tone, syllable FROM compositions WHERE placement = 0",
    "syllable_decompose": f"""
        WITH {DIMENSIONS}, {LINES}, {_READINGS}, w AS (SELECT token, translate(token, '{_toned}', '{_untoned}') AS untoned, CAST({_tone("token")} AS INTEGER) AS tone FROM unis)
        SELECT token AS syllable, onset, rime, tone FROM w JOIN analyses USING (untoned)""",
    "coverage_verify": f"""
        WITH {DIMENSIONS}, {LINES}, j AS (SELECT coalesce(count, 0) AS n, syllable IS NOT NULL AS ok, regexp_matches(coalesce(token, syllable), '[{SPECIAL}]') AS special FROM unis FULL JOIN valid ON token = syllable)
        SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS valid_tokens, CAST(coalesce(sum(n) FILTER (NOT ok AND special), 0) AS BIGINT) AS rejected_special,
            CAST(coalesce(sum(n) FILTER (NOT ok AND NOT special), 0) AS BIGINT) AS rejected_plain, count(*) FILTER (ok AND n > 0) AS seen_syllables, count(*) FILTER (ok AND n = 0) AS unseen_syllables FROM j""",
    "token_freq": f"WITH {LINES} SELECT token, count, spread FROM unis",
    "bigrams": f"WITH {LINES}, {_TWOS} SELECT * FROM twos",
    "trigrams": f"WITH {LINES}, {_TWOS}, {_THREES} SELECT * FROM threes",
    "valid_bigrams": f"WITH {DIMENSIONS}, {LINES} SELECT w AS a, b, count(*) AS count FROM grams WHERE w IN (FROM valid) AND b IN (FROM valid) GROUP BY 1, 2 HAVING count(*) >= 2",
    "attested": f"WITH {DIMENSIONS}, {LINES} SELECT token AS syllable, count AS dump_count, count AS sentence_count FROM unis WHERE token IN (FROM valid)",
    "accepted_foreign": f"WITH {DIMENSIONS}, {LINES} SELECT token, count, spread FROM unis WHERE spread >= 20 AND token NOT IN (FROM valid)",
    "collocation": f"""
        WITH {LINES}, {_TWOS}
        SELECT a, b, t.count / CAST(x.count AS DOUBLE) AS strength, least(t.count / CAST(x.count AS DOUBLE), t.count / CAST(y.count AS DOUBLE)) AS tightness
        FROM twos t JOIN unis x ON x.token = a JOIN unis y ON y.token = b""",
    "corpus_totals": f"WITH {LINES} SELECT count(*) AS sentences, CAST(coalesce(sum(len(words)), 0) AS BIGINT) AS tokens FROM lines",
    "rejected_top": f"""
        WITH {DIMENSIONS}, {LINES}
        SELECT token, count, regexp_matches(token, '[{SPECIAL}]') AS special, CAST(row_number() OVER (ORDER BY count DESC, token) AS INTEGER) AS rank
        FROM unis WHERE token NOT IN (FROM valid) QUALIFY rank <= 30""",
    "unseen_syllables": f"WITH {DIMENSIONS}, {LINES} SELECT syllable FROM valid WHERE syllable NOT IN (SELECT token FROM unis)",
    "cardinalities": f"""
        WITH {DIMENSIONS}, {_rules}, made AS (
            SELECT DISTINCT rime, CASE kind WHEN 'coda' THEN CASE WHEN suffix(rime, src) THEN substr(rime, 1, length(rime) - length(src)) || dst END
                ELSE CASE WHEN instr(rime, src) > 0 THEN substr(rime, 1, instr(rime, src) - 1) || dst || substr(rime, instr(rime, src) + length(src)) END END AS made
            FROM rimes, rules WHERE kind IN ('coda', 'nucleus'))
        SELECT 'rules_' || kind AS what, count(*) AS n FROM rules WHERE kind IN ('onset', 'tone') GROUP BY kind
        UNION ALL SELECT 'rules_rime', count(*) FROM made WHERE made <> rime AND made IN (SELECT rime FROM rimes)
        UNION ALL SELECT 'onsets', count(*) FROM onsets UNION ALL SELECT 'rimes', count(*) FROM rimes UNION ALL SELECT 'syllables', count(*) FROM valid""",
    "keystroke_words": """
        WITH t AS (SELECT concat_ws(':', conv_id, turn, role) AS session, regexp_extract_all(text, '[^\\s\\x0b,.!?;:)\\]"'']*[\\s\\x0b,.!?;:)\\]"'']') AS parts FROM conversations),
        p AS (SELECT session, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM t),
        q AS (SELECT session, CAST(sum(length(part)) OVER (PARTITION BY session ORDER BY k) - 1 AS BIGINT) AS seq, left(part, length(part) - 1) AS run, right(part, 1) AS breaker FROM p),
        w AS (SELECT session, seq, right(run, length(run) % 17) AS word, breaker FROM q WHERE length(run) % 17 > 0)
        SELECT session, seq, word, breaker, string_agg(word || breaker, '') OVER c AS context, string_agg(word, ' ') OVER c AS phrase
        FROM w WINDOW c AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "lexicon_stats": f"""
        WITH {DIMENSIONS}, {LINES}, att AS (SELECT * FROM unis WHERE token IN (FROM valid)),
        twos AS (SELECT w AS a, b, count(*) AS count FROM grams WHERE w IN (FROM valid) AND b IN (FROM valid) GROUP BY 1, 2 HAVING count(*) >= 2),
        threes AS (SELECT w, grams.b, c, count(*) AS count FROM grams JOIN twos t ON t.a = w AND t.b = grams.b WHERE c IN (FROM valid) GROUP BY 1, 2, 3 HAVING count(*) >= 2)
        SELECT 'total_tokens' AS what, CAST(coalesce(sum(count), 0) AS BIGINT) AS n FROM att UNION ALL SELECT 'attested', count(*) FROM att
        UNION ALL SELECT 'accepted', count(*) FROM unis WHERE spread >= 20 AND token NOT IN (FROM valid) UNION ALL SELECT 'bigrams', count(*) FROM twos UNION ALL SELECT 'trigrams', count(*) FROM threes""",
    "rule_closure": f"""
        WITH {DIMENSIONS}, {_rules}, made AS (
            SELECT rime, ord, variant, CASE kind WHEN 'coda' THEN CASE WHEN suffix(rime, src) THEN substr(rime, 1, length(rime) - length(src)) || dst END
                ELSE CASE WHEN instr(rime, src) > 0 THEN substr(rime, 1, instr(rime, src) - 1) || dst || substr(rime, instr(rime, src) + length(src)) END END AS made
            FROM rimes, rules WHERE kind IN ('coda', 'nucleus'))
        SELECT kind, src, dst, variant FROM rules WHERE kind IN ('onset', 'tone')
        UNION ALL SELECT 'rime', rime, made, arg_min(variant, ord) FROM made WHERE made <> rime AND made IN (SELECT rime FROM rimes) GROUP BY rime, made""",
    "telex": f"""
        WITH {DIMENSIONS}, {LINES}, {_READINGS}, keys(key, tone) AS ({_values(TONE_KEYS.items())}),
        bad AS (SELECT token AS syllable, {_full} AS f FROM unis WHERE token NOT IN (FROM valid)),
        stems AS (SELECT syllable, substr(f, 1, length(f) - 1) AS stem, tone FROM bad JOIN keys ON key = substr(f, length(f), 1)),
        read AS (SELECT DISTINCT syllable, onset, rime, tone FROM stems JOIN analyses ON untoned = translate(stem, '{_toned}', '{_untoned}'))
        SELECT syllable, f AS text FROM bad WHERE f <> syllable AND f IN (FROM valid)
        UNION SELECT r.syllable, c.syllable FROM read r JOIN compositions c ON c.onset = r.onset AND c.rime = r.rime AND c.tone = r.tone AND placement = 0""",
    "restore_options": f"""
        WITH {DIMENSIONS}, {LINES}, r AS (SELECT translate(syllable, '{_marked}', '{_plain}') AS bare, syllable AS text, CAST(coalesce(count, 0) AS BIGINT) AS frequency FROM valid LEFT JOIN unis ON token = syllable)
        SELECT bare, text, frequency, CAST(row_number() OVER (PARTITION BY bare ORDER BY frequency DESC, text) AS INTEGER) AS rank FROM r QUALIFY rank <= 12""",
    "lm_scores": f"WITH {LINES}, {_SCORES} SELECT doc_id, round(sum(s), 4) AS log_score, count(*) AS words FROM scores GROUP BY 1",
    "local_scores": f"""
        WITH {LINES}, {_SCORES}, l AS (SELECT doc_id, sum(s) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v FROM scores)
        SELECT doc_id, round(min(v), 4) AS lowest, round(max(v), 4) AS highest FROM l GROUP BY 1""",
    "strip_marks": f"""
        WITH {DIMENSIONS} SELECT syllable, translate(syllable, '{_marked}', '{_plain}') AS bare, translate(syllable, '{_toned}', '{_untoned}') AS untoned, CAST({_tone("syllable")} AS INTEGER) AS tone FROM valid""",
    "special_letters": f"SELECT doc_id, len(regexp_extract_all(lower(text), '[{SPECIAL}]')) AS letters FROM documents",
    "rolling_context": """
        SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' ') AS context FROM events""",
}
