"""The registered queries as SQL for DuckDB, where SQL can express them.

Written from the definitions of the detectors, not from the Spark code: common pieces are
SQL texts over ``text`` and are put together below.
"""

from __future__ import annotations

from ..operators.detectors import LANGUAGES

SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LETTERS = r"\p{L}\p{M}"
NON_SPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"

def trim(t: str) -> str:
    return f"regexp_replace({t}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def words(t: str) -> str:
    return rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}'']+')"


def count(t: str, chosen: str) -> str:
    return f"length(regexp_replace({t}, '[^{chosen}]+', '', 'g'))"


def non_spaced(t: str) -> str:
    total = count(t, LETTERS)
    return f"(CASE WHEN {total} = 0 THEN 0.0::DOUBLE ELSE {count(t, NON_SPACED)}::DOUBLE / {total} END)"


BARE = f"regexp_replace(text, '[{SPACE}]+', '', 'g')"
EMPTY = rf"""(CASE WHEN NOT regexp_matches({trim('text')}, '[\p{{L}}\p{{N}}'']')
    OR {trim(f"regexp_replace(regexp_replace({trim('text')}, '```[a-z]*[{SPACE}]*```', '', 'gi'), '^[{{}}\\[\\]\"''{SPACE},.:;!?-]+$', '', 'g')")} = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"""


def short(least: int) -> str:
    return f"greatest(0.0::DOUBLE, 1 - length({trim('text')})::DOUBLE / {least})"


def repetition(w: str, n: int) -> str:
    return f"(CASE WHEN len({w}) < {4 * n} THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))))::DOUBLE / (len({w}) - {n - 1}) END)"


def coverage(r: str, most: int) -> str:
    """Over a reversed list."""
    periods = f"list_filter(range(1, least({most}, len({r}) // 3) + 1), lambda p: {r}[1:p] = {r}[p + 1:2 * p] AND {r}[1:p] = {r}[2 * p + 1:3 * p])"
    run = f"coalesce(list_position(list_transform(range(1, len({r}) - p + 1), lambda i: {r}[i] = {r}[i + p]), false) - 1, len({r}) - p)"
    cover = f"least(1.0::DOUBLE, ((1 + {run} // p) * p)::DOUBLE / len({r}))"
    return f"(CASE WHEN len({r}) < 6 THEN 0.0::DOUBLE ELSE coalesce(list_max(list_transform({periods}, lambda p: {cover})), 0.0::DOUBLE) END)"


def lz(source: str) -> str:
    """``WITH`` parts giving ``lz``: tokens per character of the greedy parse of each distinct head ``s`` of texts.

    The longest earlier match of every place is found by halving steps, from the places the parse picks its way.
    """
    found = lambda m: f"instr(w, substring(w, k + 1, {m})) <= k"
    longest = f"(SELECT *, CASE WHEN NOT {found(4)} THEN 3 WHEN n - i + 1 < 16 OR NOT {found(16)} THEN 4 ELSE 16 END AS m FROM lz_places)"
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        able = f"m >= {16 if step > 8 else 4} AND m + {step} <= least(255, n - i + 1) AND {found(f'm + {step}')}"
        longest = f"(SELECT * REPLACE (CASE WHEN {able} THEN m + {step} ELSE m END AS m) FROM {longest})"
    return f"""lz_heads AS (SELECT s, length(s) AS n FROM (SELECT DISTINCT text[1:4000] AS s FROM {source}) WHERE length(s) >= 64),
lz_places AS (SELECT s, n, i, least(i - 1, 1024) AS k, substring(s, greatest(1, i - 1024), least(i - 1, 1024) + 255) AS w FROM (SELECT *, unnest(range(1, n - 2)) AS i FROM lz_heads)),
lz_jumps AS (SELECT s, n, list({{'next': CASE WHEN m > 3 THEN m ELSE 1 END, 'tokens': i}} ORDER BY i) AS j FROM {longest} GROUP BY s, n),
lz AS (SELECT s, (r.tokens + n - (r.next - 1))::DOUBLE / n AS ratio FROM (
    SELECT s, n, list_reduce(list_prepend({{'next': 1::BIGINT, 'tokens': 0::BIGINT}}, j), lambda a, x: CASE WHEN x.tokens = a.next THEN {{'next': a.next + x.next, 'tokens': a.tokens + 1}} ELSE a END) AS r FROM lz_jumps))"""


RATIO = "coalesce(ratio, 1.0::DOUBLE)"
ENTROPY = f"(CASE WHEN length({trim('text')}) < 64 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - {RATIO} / 0.32)) END)"


def parts(source: str = "documents", entropy: bool = False, texts: str | None = None) -> str:
    """Of every text: words, words of the head, the tail's words and characters from the end, and the tail's mode.

    With ``entropy`` the ratio of the greedy parse too, made from ``texts`` where that is a plainer name of the source.
    """
    rows = f"{source} LEFT JOIN lz ON lz.s = text[1:4000]" if entropy else source
    return (f"{lz(texts or source)}, " if entropy else "") + f"""parts AS (
    SELECT *, CASE WHEN {non_spaced('tail')} >= 0.5 THEN 'char' ELSE 'word' END AS mode,
        list_reverse(w[greatest(1, len(w) - 199):]) AS rw, list_reverse(CASE WHEN tail = '' THEN [] ELSE string_split(tail, '') END) AS rc
    FROM (SELECT *, {words('text')} AS w, {words('text[1:8000]')} AS wh, right({BARE}, 400) AS tail FROM {rows}))"""


PARTS = parts()


def tail(mode: str) -> str:
    by_char = f"(CASE WHEN len(rc) < 80 THEN 0.0::DOUBLE ELSE {coverage('rc', 80)} END)"
    return f"(CASE WHEN {mode} = 'char' THEN {by_char} ELSE {coverage('rw', 40)} END)"


def unclosed(t: str) -> str:
    more = lambda a, b: f"len(string_split({t}, '{a}')) > len(string_split({t}, '{b}'))"
    return f"({more('{', '}')} OR {more('[', ']')} OR {more('(', ')')})"


_T = trim("text")
TRUNCATION = rf"""(CASE WHEN {_T} = '' OR (regexp_matches({_T}, '^[{{\[]') AND json_valid({_T})) THEN 0.0::DOUBLE
    WHEN (len(string_split({_T}, '```')) - 1) % 2 = 1 THEN 0.9::DOUBLE WHEN {unclosed(_T)} THEN 0.8::DOUBLE
    WHEN NOT regexp_matches({_T}, '[.!?"''`’”)\]}}:;。！？][{SPACE}]*$') THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END)"""
REASON = "['stop', 'length', 'MAX_TOKENS', 'content_filter', 'token_limit'][doc_id % 5 + 1]"
STOPPED = f"(lower({REASON}) IN ('length', 'max_tokens', 'maxtokens', 'max_output_tokens', 'token_limit'))"
TRUNCATION_WITH_REASON = f"(CASE WHEN {STOPPED} THEN 1.0::DOUBLE ELSE {TRUNCATION} END)"

STRIPPED = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text[1:8000], '(?s)```.*?```', ' ', 'g'), '(?s)```.*$', ' '), '`[^`\n]*`', ' ', 'g'), '(?i)\bhttps?://[^{SPACE}]+', ' ', 'g')"
JUDGED = rf"regexp_replace(regexp_replace({STRIPPED}, '[^\p{{L}}\p{{M}}]+', '', 'g'), '[\p{{Common}}\p{{Inherited}}]+', '', 'g')"


def script(chosen: str, least: int = 12) -> str:
    return f"(CASE WHEN length(judged) < {least} THEN 0.0::DOUBLE ELSE 1 - {count('judged', chosen)}::DOUBLE / length(judged) END)"


def share(language: str) -> str:
    known = ", ".join(f"'{w}'" for w in LANGUAGES[language])
    return f"(len(list_filter(w, lambda x: x IN ({known})))::DOUBLE / len(w))"


SHARES = "shares AS (SELECT *, " + ", ".join(f"{share(x)} AS s_{x}" for x in LANGUAGES) + f" FROM (SELECT *, {words('text')} AS w FROM documents))"
BEST = f"greatest({', '.join(f's_{x}' for x in LANGUAGES)})"


def mismatch(target: str) -> str:
    return f"(CASE WHEN len(w) < 25 OR {target} IS NULL OR {BEST} = 0 OR {target} >= {BEST} THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({BEST} - {target}) / {BEST}) END)"


TARGET = "CASE lang " + " ".join(f"WHEN '{x}' THEN s_{x}" for x in LANGUAGES) + " END"


def verdict(least: int, rep: float, word: float, char: float, truncated: float | None = None, json: bool = False, entropy: float | None = None) -> tuple[str, str, str]:
    """``WITH`` parts giving ``scored`` with scores, thresholds and the list of reasons that fire; its columns; the list."""
    cut = f", {TRUNCATION} AS truncated" if truncated is not None else ""
    dense = f", {ENTROPY} AS dense" if entropy is not None else ""
    fired = [
        ("TOO_SHORT", "too_short > 0"), ("REPETITION", f"rep > {rep}"), ("TAIL_LOOP", f"tail > CASE WHEN mode = 'char' THEN {char} ELSE {word} END"), *([("LOW_ENTROPY", f"dense > {entropy}")] if entropy is not None else []),
        *([("TRUNCATED", f"truncated > {truncated}")] if truncated is not None else []), *([("INVALID_JSON", "invalid > 0")] if json else []),
    ]
    bad = f", CASE WHEN json_valid({_T}) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS invalid" if json else ""
    reasons = "CASE WHEN empty >= 1 THEN ['EMPTY'] ELSE list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in fired) + "], lambda x: x IS NOT NULL) END"
    scored = f"scored AS (SELECT *, {reasons} AS reasons FROM (SELECT doc_id, text, mode, {EMPTY} AS empty, {short(least)} AS too_short, {repetition('wh', 3)} AS rep, {tail('mode')} AS tail{dense}{cut}{bad} FROM parts))"
    shown = ["empty", "too_short", "rep", "tail"] + ["dense"] * (entropy is not None) + ["truncated"] * (truncated is not None)
    names = ["score_empty", "score_too_short", "score_repetition", "score_tail_loop"] + ["score_low_entropy"] * (entropy is not None) + ["score_truncated"] * (truncated is not None)
    columns = ", ".join(f"round(CASE WHEN empty >= 1 AND '{a}' <> 'empty' THEN NULL ELSE {a} END, 6) AS {b}" for a, b in zip(shown, names, strict=True))
    return f"WITH {parts(entropy=entropy is not None)}, {scored}", columns, reasons


def verdict_query(*args: object, **options: object) -> str:
    parts, columns, _ = verdict(*args, **options)
    return f"{parts} SELECT doc_id, len(reasons) = 0 AS ok, array_to_string(reasons, ',') AS reasons, {columns} FROM scored"


def reason_counts(chat: tuple[str, str, str]) -> str:
    dense = "WHEN 'LOW_ENTROPY' THEN dense " if "dense" in chat[1] else ""
    return f"""{chat[0]}, fired AS (SELECT unnest(reasons) AS code, * EXCLUDE reasons FROM scored)
SELECT code, count(*) AS n, round(max(CASE code WHEN 'EMPTY' THEN 1.0 WHEN 'TOO_SHORT' THEN too_short WHEN 'REPETITION' THEN rep {dense}ELSE tail END)::DOUBLE, 6) AS worst FROM fired GROUP BY code"""


def calibrate_maps(chat: tuple[str, str, str]) -> str:
    code, mode, score = ("'LOW_ENTROPY', ", "NULL, ", "dense, ") if "dense" in chat[1] else ("", "", "")
    return f"""{chat[0]}, long AS (SELECT unnest(['EMPTY', 'TOO_SHORT', 'REPETITION', {code}'TAIL_LOOP']) AS code, unnest([NULL, NULL, NULL, {mode}mode]) AS mode, unnest([empty, too_short, rep, {score}tail]) AS score, empty FROM scored)
SELECT code, mode, count(*) AS n, count(*) FILTER (score > 0) AS non_zero, round(max(score), 6) AS max, round(quantile_cont(score, 0.99), 6) AS p99 FROM long WHERE empty < 1 OR code = 'EMPTY' GROUP BY code, mode"""


def check_footer(chat: tuple[str, str, str]) -> str:
    return f"{chat[0]} SELECT count(*) AS checked, count(*) FILTER (len(reasons) > 0) AS degenerate, 0::BIGINT AS unrecognised, max(len(reasons) > 0)::INTEGER AS exit_code FROM scored"


WHOLE_CHAT = verdict(12, 0.4, 0.5, 0.7, entropy=0.75)

SCORES = f"""{PARTS}, scores AS (
    SELECT doc_id, unnest(['REPETITION', 'TAIL_LOOP', 'TOO_SHORT']) AS code, unnest([NULL, mode, NULL]) AS mode,
        unnest([round({repetition('wh', 3)}, 6), round({tail('mode')}, 6), round({short(400)}, 6)]) AS score
    FROM parts)"""

EXTRACTED = "CASE (conv_id + turn) % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE text END"

PAYLOAD = r"""payloads AS (SELECT event_id, CASE event_id % 6 WHEN 1 THEN props || ' x' WHEN 2 THEN props[1:length(props) - 1] WHEN 3 THEN replace(props, '"', '''')
    WHEN 4 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE props END AS payload, event_id % 6 IN (0, 4, 5) AS valid, CASE event_id % 6 WHEN 4 THEN props END AS inside FROM events)"""

GIVEN = """given AS (SELECT s.conv_id, s.turn, s.text, coalesce(string_agg(g.text, chr(10) || chr(10) ORDER BY g.turn), '') AS prompt
    FROM conversations s LEFT JOIN conversations g ON g.conv_id = s.conv_id AND g.turn < s.turn AND g.role IN ('system', 'developer', 'user', 'human') AND trim(g.text) <> ''
    WHERE s.role = 'assistant' GROUP BY ALL)"""
LOOP = "repeat('again and again ', 30)"
ARGUMENTS = f"CASE WHEN conv_id % 2 = 0 THEN '{{\"query\":\"' || {LOOP} || '\"}}' ELSE '{{\"id\": 7}}' END"


def envelope(finish: str, arguments: str, prompt: str) -> str:
    return f"WITH {GIVEN} SELECT conv_id, turn, text, conv_id % 3 = 0 AS has_tool_calls, {finish} AS finish_reason, CASE WHEN conv_id % 3 = 0 THEN {arguments} ELSE '' END AS arguments, {prompt} AS prompt FROM given"


BRIEF = "CASE WHEN prompt = '' THEN 'Be brief.' ELSE 'Be brief.' || chr(10) || chr(10) || prompt END"


def runs(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) < {n} THEN [] ELSE list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')) END"


def replay(window: str, extra: str = "") -> str:
    """First failing check of texts that come in chunks of 100: checks at 300, then every 400, then the rest."""
    return f"""
WITH places AS (
    SELECT doc_id, text, length(text) AS n,
        CASE WHEN length(text) < 240 THEN []::BIGINT[] ELSE list_transform(range(0, CASE WHEN length(text) - least(300, length(text)) < 400 THEN 1 ELSE (length(text) - 700) // 400 + 2 END),
            lambda i: least(least(300, length(text)) + i * 400, length(text))) END AS p
    FROM documents),
due AS (SELECT doc_id, n, unnest(p) AS p, text AS whole FROM places),
spans AS (SELECT doc_id, n, p, whole, substring(whole, greatest(1, p - 1999), least(p, 2000)) AS text FROM due),
parts AS (
    SELECT *, CASE WHEN {non_spaced('tail')} >= 0.5 THEN 'char' ELSE 'word' END AS mode,
        list_reverse(w[greatest(1, len(w) - 199):]) AS rw, list_reverse(CASE WHEN tail = '' THEN [] ELSE string_split(tail, '') END) AS rc
    FROM (SELECT *, {words('text')} AS w, {words('text')} AS wh, right({BARE}, 400) AS tail FROM spans)),
scored AS (SELECT *, CASE WHEN {EMPTY} >= 1 THEN ['EMPTY'] ELSE list_filter([CASE WHEN {repetition('wh', 3)} > 0.4 THEN 'REPETITION' END,
    CASE WHEN {tail('mode')} > CASE WHEN mode = 'char' THEN 0.7 ELSE 0.5 END THEN 'TAIL_LOOP' END], lambda x: x IS NOT NULL) END AS reasons FROM parts),
caught AS (SELECT doc_id, min(p) AS p, arg_min(array_to_string(reasons, ','), p) AS reasons FROM {window} GROUP BY doc_id)
SELECT places.doc_id, n::BIGINT AS n_chars, len(places.p)::BIGINT AS checks, coalesce(caught.p, -1)::BIGINT AS caught_at, coalesce(caught.reasons, '') AS reasons FROM places LEFT JOIN caught USING (doc_id)"""


ORACLES = {
    "empty_short": f"SELECT doc_id, {EMPTY} AS empty, round({short(400)}, 6) AS short FROM documents",
    "words_stats": f"SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct, list_max(list_transform(w, lambda x: length(x)))::BIGINT AS longest FROM (SELECT doc_id, {words('text')} AS w FROM documents)",
    "char_stats": f"SELECT doc_id, length({BARE})::BIGINT AS n_chars, round({non_spaced('text')}, 6) AS ratio, CASE WHEN {non_spaced('text')} >= 0.5 THEN 'char' ELSE 'word' END AS mode FROM documents",
    "excerpt_trim": f"""
WITH flat AS (SELECT *, {trim(f"regexp_replace(text, '[{SPACE}]+', ' ', 'g')")} AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE f[1:60] || '…' END AS excerpt, length({trim("'  ' || chr(10) || text || chr(9)")})::BIGINT AS trimmed,
    length({STRIPPED.replace('text[1:8000]', "text || ' `x` https://e.org/a ```js' || chr(10) || 'b```'")})::BIGINT AS linguistic FROM flat""",
    "repetition": f"WITH {PARTS} SELECT doc_id, round({repetition('wh', 3)}, 6) AS score FROM parts",
    "repetition_n4": f"WITH {PARTS} SELECT doc_id, round({repetition('wh', 4)}, 6) AS score FROM parts",
    "tail_loop": f"WITH {PARTS} SELECT doc_id, round({tail('mode')}, 6) AS score, mode FROM parts",
    "tail_loop_word": f"WITH {PARTS} SELECT doc_id, round({coverage('rw', 40)}, 6) AS score, 'word' AS mode FROM parts",
    "tail_loop_char": f"WITH {PARTS} SELECT doc_id, round(CASE WHEN len(rc) < 80 THEN 0.0::DOUBLE ELSE {coverage('rc', 80)} END, 6) AS score, 'char' AS mode FROM parts",
    "truncation": f"SELECT doc_id, {TRUNCATION} AS score FROM documents",
    "truncation_finish_reason": f"SELECT doc_id, {TRUNCATION_WITH_REASON} AS score FROM documents",
    "script_mismatch": rf"SELECT doc_id, round({script(r'\p{Latin}')}, 6) AS latin, round({script(r'\p{Han}\p{Greek}')}, 6) AS other, 0.0::DOUBLE AS unknown FROM (SELECT doc_id, {JUDGED} AS judged FROM documents)",
    "script_profile": "SELECT doc_id, " + ", ".join(
        rf"CASE WHEN length(judged) = 0 THEN NULL ELSE round({count('judged', chosen)}::DOUBLE / length(judged), 6) END AS share_{name}" for name, chosen in (("latin", r"\p{Latin}"), ("han", r"\p{Han}"), ("cyrillic", r"\p{Cyrillic}"), ("greek", r"\p{Greek}"))
    ) + rf""", CASE WHEN length(judged) = 0 THEN NULL ELSE round((length(judged) - {count('judged', r'\p{Latin}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Cyrillic}\p{Arabic}\p{Devanagari}\p{Greek}\p{Hebrew}\p{Thai}')})::DOUBLE / length(judged), 6) END AS share_other
FROM (SELECT doc_id, {JUDGED} AS judged FROM documents)""",
    "language_profile": f"WITH {SHARES} SELECT doc_id, " + ", ".join(f"CASE WHEN len(w) = 0 THEN NULL ELSE round(s_{x}, 6) END AS share_{x}" for x in LANGUAGES) + " FROM shares",
    "language_mismatch": f"WITH {SHARES} SELECT doc_id, round({mismatch(TARGET)}, 6) AS score, round({mismatch('s_en')}, 6) AS as_en FROM shares",
    "json_strict": f"WITH {PAYLOAD} SELECT event_id, valid AND inside IS NULL AS valid, coalesce(inside, payload) AS candidate FROM payloads",
    "json_required_keys": f"""WITH {PAYLOAD} SELECT event_id, 1.0::DOUBLE AS score, CASE WHEN valid THEN 'missing-keys' ELSE 'unparseable' END AS reason,
    CASE WHEN valid THEN 'absent' END AS missing FROM payloads""",
    "json_string_leaves": "SELECT conv_id, turn, 4::BIGINT AS n_leaves, role || '|' || text || '|' || role || '|' || text AS leaves FROM conversations",
    "schema_check": f"""WITH {PAYLOAD} SELECT event_id, CASE WHEN valid THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score,
    CASE WHEN valid THEN ((coalesce(inside, payload)->>'k')::BIGINT % 2 = 0)::VARCHAR END AS even, NULL::VARCHAR AS issues FROM payloads""",
    "prompt_echo_conversations": f"""
WITH {GIVEN}, w AS (SELECT conv_id, turn, {words('text[1:8000]')} AS o, {words('prompt[1:8000]')} AS s FROM given),
r AS (SELECT conv_id, turn, len(o) AS n, len(s) AS m, {runs('o', 5)} AS a, {runs('s', 5)} AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN n < 8 OR m < 5 THEN 0.0::DOUBLE ELSE len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) END, 6) AS score FROM r""",
    "benchmark_echo": f"""
WITH known AS (SELECT DISTINCT unnest({runs('w', 5)}) AS run FROM (SELECT {words('text')} AS w FROM benchmark)),
out AS (SELECT doc_id, unnest({runs('w', 5)}) AS run FROM (SELECT doc_id, {words('text')} AS w FROM documents))
SELECT doc_id, count(*)::BIGINT AS n_runs, count(known.run)::BIGINT AS hits, round(count(known.run)::DOUBLE / count(*), 6) AS score FROM out LEFT JOIN known USING (run) GROUP BY doc_id""",
    "verdict_chat_native": verdict_query(12, 0.4, 0.5, 0.7),
    "verdict_long_form_native": verdict_query(200, 0.35, 0.4, 0.6, 0.75),
    "verdict_strict_json": verdict_query(2, 0.6, 0.6, 0.75, 0.75, True),
    "verdict_chat": verdict_query(12, 0.4, 0.5, 0.7, entropy=0.75),
    "verdict_long_form": verdict_query(200, 0.35, 0.4, 0.6, 0.75, entropy=0.7),
    "verdict_overlay": verdict_query(80, 0.2, 0.5, 0.6, entropy=0.75),
    "verdict_lenient": verdict_query(1, 0.7, 0.7, 0.85, entropy=0.9),
    "low_entropy": f"WITH {lz('documents')} SELECT doc_id, round({RATIO}, 6) AS ratio, round({ENTROPY}, 6) AS score FROM documents LEFT JOIN lz ON lz.s = text[1:4000]",
    "reason_counts": reason_counts(WHOLE_CHAT),
    "check_footer": check_footer(WHOLE_CHAT),
    "assert_output": f"{WHOLE_CHAT[0]} SELECT doc_id FROM scored WHERE len(reasons) = 0",
    "verdict_lines_read": f"{WHOLE_CHAT[0]} SELECT doc_id, 'doc:' || doc_id AS label, len(reasons) = 0 AS ok, array_to_string(reasons, ',') AS reasons, CASE WHEN empty < 1 THEN round(rep, 6) END AS repetition, CASE WHEN empty < 1 THEN mode END AS mode FROM scored",
    "calibrate_summary": f"""
WITH {SCORES},
ranked AS (SELECT *, row_number() OVER g AS i, lead(score) OVER g AS above, count(*) OVER (PARTITION BY code, mode) AS n FROM scores WINDOW g AS (PARTITION BY code, mode ORDER BY score)),
gaps AS (SELECT code, mode, score AS below, above, n - i AS count, (n - i)::DOUBLE / n AS share FROM ranked WHERE n >= 20 AND i - 1 >= n // 2 AND above - score >= 0.15
    QUALIFY row_number() OVER (PARTITION BY code, mode ORDER BY above - score DESC, i) = 1),
stats AS (SELECT code, mode, count(*) AS n, count(*) FILTER (score > 0) AS non_zero, min(score) AS min, max(score) AS max, quantile_cont(score, [0.5, 0.9, 0.99, 0.999]) AS p FROM scores GROUP BY code, mode)
SELECT s.code, s.mode, n, non_zero, min, max, round(p[1], 6) AS p50, round(p[2], 6) AS p90, round(p[3], 6) AS p99, round(p[4], 6) AS p999,
    round(below, 6) AS gap_below, round(above, 6) AS gap_above, coalesce(g.count, 0) AS gap_count, round(share, 6) AS gap_share, round(coalesce((below + above) / 2, p[3]), 3) AS suggested,
    ((n * 0.01 < 10)::INT + (max = 0 OR p[1] = max)::INT + (below IS NULL OR g.count < 5)::INT)::BIGINT AS n_caveats,
    CASE s.code WHEN 'REPETITION' THEN 'max_repetition' WHEN 'TAIL_LOOP' THEN CASE WHEN s.mode = 'char' THEN 'max_char_tail_loop' ELSE 'max_tail_loop' END END AS option, s.code IN ('EMPTY', 'TOO_SHORT') AS rate_only
FROM stats s LEFT JOIN gaps g ON g.code = s.code AND g.mode IS NOT DISTINCT FROM s.mode""",
    "calibrate_maps": calibrate_maps(WHOLE_CHAT),
    "label_margins": f"""
WITH {SCORES}, pairs AS (SELECT code, mode, coalesce(max(score) FILTER (quality <> 0), 0.0) AS healthy_max, min(score) FILTER (quality = 0 AND score > 0.05) AS degenerate_min FROM scores JOIN labels USING (doc_id) GROUP BY code, mode)
SELECT code, mode, round(healthy_max, 6) AS healthy_max, round(degenerate_min, 6) AS degenerate_min, round(degenerate_min - healthy_max, 6) AS margin, degenerate_min - healthy_max > 0.2 AS safe FROM pairs""",
    "extract_text": f"SELECT conv_id, turn, {EXTRACTED} AS text FROM conversations",
    "extract_scores": f"""
WITH {SCORES}, wide AS (SELECT doc_id, max(score) FILTER (code = 'REPETITION') AS rep, max(score) FILTER (code = 'TAIL_LOOP') AS tail, max(mode) AS mode FROM scores GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN rep END AS repetition, CASE WHEN doc_id % 3 < 2 THEN tail END AS tail_loop, CASE WHEN doc_id % 3 = 1 THEN mode END AS mode FROM wide""",
    "envelope_openai_chat": envelope("CASE WHEN turn % 4 = 1 THEN 'length' ELSE 'stop' END", ARGUMENTS, "prompt"),
    "envelope_openai_responses": envelope("CASE WHEN turn % 4 = 1 THEN 'max_output_tokens' END", ARGUMENTS, BRIEF),
    "envelope_anthropic": envelope("CASE WHEN turn % 4 = 1 THEN 'max_tokens' ELSE 'end_turn' END", ARGUMENTS.replace('"id": 7', '"id":7'), BRIEF),
    "envelope_ai_sdk": envelope("CASE WHEN turn % 4 = 1 THEN 'length' ELSE 'stop' END", ARGUMENTS, "prompt"),
    "tool_arguments_worst": f"""
WITH {GIVEN} SELECT conv_id, turn, false AS ok, round(1 - 3.0::DOUBLE / 88, 6) AS repetition FROM given WHERE conv_id % 6 = 0""",
    "stream_events": """
SELECT conv_id, turn, surface, text AS delta, false AS tool_call, CASE surface WHEN 'openai_chat' THEN 'stop' END AS finish_reason
FROM conversations, (SELECT unnest(['openai_chat', 'openai_responses', 'anthropic', 'ai_sdk']) AS surface)""",
    "stream_replay_first_catch": replay("(SELECT * FROM scored WHERE len(reasons) > 0)"),
    "stream_replay_early_document": replay(rf"""(
    SELECT doc_id, p, list_concat(reasons, CASE WHEN early AND NOT hidden AND length(judged) >= 12 AND 1 - {count('judged', r'\p{Cyrillic}')}::DOUBLE / length(judged) > 0.9 THEN ['SCRIPT_MISMATCH'] ELSE [] END) AS reasons
    FROM (SELECT *, {JUDGED.replace('text[1:8000]', 'whole[1:least(p, 8000)]')} AS judged, p IN (300 + 400, 1500, 3100, 6300, 12700) OR (p = n AND (p % 400 <> 300)
        AND p >= CASE WHEN p > 6300 THEN 12600 WHEN p > 3100 THEN 6200 WHEN p > 1500 THEN 3000 WHEN p > 700 THEN 1400 ELSE 600 END AND p < 12700) AS early,
        {EMPTY.replace('text', 'whole[1:least(p, 8000)]')} >= 1 AS hidden FROM scored)
    WHERE len(reasons) > 0 OR (early AND NOT hidden AND length(judged) >= 12 AND 1 - {count('judged', r'\p{Cyrillic}')}::DOUBLE / length(judged) > 0.9))"""),
}

_ENDED = f"ended AS ({WHOLE_CHAT[0]} SELECT doc_id, array_to_string(reasons, ',') AS own FROM scored), caught AS ({ORACLES['stream_replay_first_catch']})"
ORACLES["stateful_stream_guard"] = f"""
WITH {_ENDED} SELECT doc_id, CASE WHEN caught_at >= 0 THEN caught_at ELSE n_chars END AS caught_at, CASE WHEN caught_at >= 0 THEN 'window' ELSE 'end' END AS kind, CASE WHEN caught_at >= 0 THEN reasons ELSE own END AS reasons
FROM caught JOIN ended USING (doc_id) WHERE caught_at >= 0 OR own <> ''"""
_FIRED = """SELECT doc_id, greatest(1, ceil(passed / 100))::BIGINT AS n_chunks, passed AS n_chars, caught_at AS fired_at, reasons AS fired_reasons, CASE WHEN caught_at < 0 THEN own END AS end_reasons{more}
FROM (SELECT *, CASE WHEN caught_at >= 0 THEN caught_at ELSE n_chars END AS passed FROM caught JOIN ended USING (doc_id))"""
ORACLES["stream_fired"] = f"WITH {_ENDED} {_FIRED.format(more='')}"
ORACLES["stream_late"] = f"WITH {_ENDED} {_FIRED.format(more=', 1::BIGINT AS n_late')}"

_LOOPED = "conv_id % 2 = 0"


def merged(entropy: bool) -> str:
    """Tool-call turns: the preamble's reasons and those of looping arguments."""
    before = parts("(SELECT * FROM given WHERE conv_id % 3 = 0)", entropy)
    dense = f" + ({ENTROPY} > 0.75)::INT" if entropy else ""
    return f"""
WITH {GIVEN}, {before}, judged AS (SELECT conv_id, turn, text, {repetition('wh', 3)} AS rep, {tail('mode')} AS tail, mode{', ratio' if entropy else ''} FROM parts),
counted AS (SELECT *, ((rep > 0.4)::INT{dense} + (tail > CASE WHEN mode = 'char' THEN 0.7 ELSE 0.5 END)::INT + CASE WHEN {_LOOPED} THEN 2 ELSE 0 END)::BIGINT AS n_reasons FROM judged)
SELECT conv_id, turn, n_reasons = 0 AS ok, n_reasons, round(greatest(rep, CASE WHEN {_LOOPED} THEN 1 - 3.0::DOUBLE / 88 ELSE 0.0 END), 6) AS repetition FROM counted"""


ORACLES["merge_verdicts"] = merged(True)

_ECHO = f"""(CASE WHEN {non_spaced('text[1:8000]')} >= 0.5 THEN NULL WHEN len(o) < 40 OR len(p) < 5 THEN 0.0::DOUBLE
    ELSE len(list_filter({runs('o', 5)}, lambda x: list_contains({runs('p', 5)}, x)))::DOUBLE / (len(o) - 4) END)"""
_SPOKEN = f"(SELECT *, {words('text[1:8000]')} AS o, {words('prompt[1:8000]')} AS p FROM given)"
ORACLES["score_envelopes"] = f"""
WITH {GIVEN}, {parts(_SPOKEN, True, 'given')},
judged AS (SELECT conv_id, turn, {EMPTY} AS empty, {short(12)} AS too_short, {repetition('wh', 3)} AS rep, {tail('mode')} AS tail, mode, {ENTROPY} AS dense, {_ECHO} AS echo,
    CASE WHEN turn % 4 = 1 THEN 1.0::DOUBLE ELSE {TRUNCATION} END AS truncated FROM parts),
fired AS (SELECT *, conv_id % 3 = 0 AS tool, CASE WHEN empty >= 1 THEN ['EMPTY'] ELSE list_filter([CASE WHEN NOT tool AND too_short > 0 THEN 'TOO_SHORT' END, CASE WHEN rep > 0.4 THEN 'REPETITION' END,
    CASE WHEN tail > CASE WHEN mode = 'char' THEN 0.7 ELSE 0.5 END THEN 'TAIL_LOOP' END, CASE WHEN dense > 0.75 THEN 'LOW_ENTROPY' END, CASE WHEN NOT tool AND truncated > 0.75 THEN 'TRUNCATED' END,
    CASE WHEN echo > 0.6 THEN 'PROMPT_ECHO' END], lambda x: x IS NOT NULL) END AS own FROM judged),
whole AS (SELECT *, CASE WHEN tool AND {_LOOPED} THEN list_concat(own, ['REPETITION', 'TAIL_LOOP']) ELSE own END AS reasons FROM fired)
SELECT conv_id, turn, len(reasons) = 0 AS ok, array_to_string(reasons, ',') AS reasons FROM whole"""

ORACLES["verdict_full"] = f"""
WITH {parts(f"(SELECT *, {JUDGED} AS judged FROM documents)", True, 'documents')},
shared AS (SELECT *, {', '.join(f"{share(x)} AS s_{x}" for x in LANGUAGES)} FROM parts),
measured AS (SELECT doc_id, mode, {EMPTY} AS empty, {short(12)} AS too_short, {repetition('wh', 3)} AS rep, {tail('mode')} AS tail, {ENTROPY} AS dense, {TRUNCATION_WITH_REASON} AS truncated,
    CASE WHEN json_valid({_T}) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS invalid, {script(r'\p{Latin}')} AS script, CASE WHEN lang IS NOT NULL THEN {mismatch(TARGET)} END AS language FROM shared),
fired AS (SELECT *, CASE WHEN empty >= 1 THEN ['EMPTY'] ELSE list_filter([CASE WHEN too_short > 0 THEN 'TOO_SHORT' END, CASE WHEN rep > 0.4 THEN 'REPETITION' END, CASE WHEN tail > CASE WHEN mode = 'char' THEN 0.7 ELSE 0.5 END THEN 'TAIL_LOOP' END,
    CASE WHEN dense > 0.75 THEN 'LOW_ENTROPY' END, CASE WHEN truncated > 0.75 THEN 'TRUNCATED' END, CASE WHEN invalid > 0 THEN 'INVALID_JSON' END, CASE WHEN script > 0.5 THEN 'SCRIPT_MISMATCH' END, CASE WHEN language > 0.6 THEN 'LANG_MISMATCH' END], lambda x: x IS NOT NULL) END AS reasons FROM measured)
SELECT doc_id, len(reasons) = 0 AS ok, array_to_string(reasons, ',') AS reasons, empty AS score_empty, """ + ", ".join(
    f"round(CASE WHEN empty < 1 THEN {a} END, 6) AS score_{b}"
    for a, b in (("too_short", "too_short"), ("rep", "repetition"), ("tail", "tail_loop"), ("dense", "low_entropy"), ("truncated", "truncated"), ("invalid", "invalid_json"), ("script", "script_mismatch"), ("language", "lang_mismatch"))
) + " FROM fired"

_LONG_FORM = verdict(200, 0.35, 0.4, 0.6, 0.75, entropy=0.7)[0].replace(f"{TRUNCATION} AS truncated", f"{TRUNCATION_WITH_REASON} AS truncated")
ORACLES["stream_end"] = f"""
{_LONG_FORM.replace(" AS reasons FROM (SELECT doc_id", " AS ended, list_filter([CASE WHEN rep > 0.35 THEN 'REPETITION' END, CASE WHEN tail > CASE WHEN mode = 'char' THEN 0.6 ELSE 0.4 END THEN 'TAIL_LOOP' END, CASE WHEN dense > 0.7 THEN 'LOW_ENTROPY' END], lambda x: x IS NOT NULL) AS before FROM (SELECT doc_id")},
chosen AS (SELECT *, CASE WHEN doc_id % 7 <> 3 THEN ended WHEN empty >= 1 THEN ['EMPTY'] ELSE before END AS reasons FROM scored WHERE doc_id % 7 <> 3 OR {_T} <> '')
SELECT doc_id, length(text)::BIGINT AS at_chars, CASE WHEN doc_id % 7 = 3 THEN 'preamble' ELSE 'end' END AS kind, len(reasons) = 0 AS ok, array_to_string(reasons, ',') AS reasons FROM chosen"""
ORACLES["stream_policies"] = f"""
SELECT doc_id, CASE WHEN policy = 'abort' AND caught_at >= 0 THEN least(caught_at, n_chars) ELSE n_chars END::BIGINT AS n_chars, policy
FROM ({ORACLES['stream_replay_first_catch']}), (SELECT unnest(['abort', 'ignore']) AS policy)"""
ORACLES["scan_responses"] = """
SELECT doc_id, line_no, sha256(text) AS text_sha256, (SELECT count(*) FROM documents WHERE doc_id % 11 <> 4) AS lines, (SELECT count(*) FROM documents WHERE doc_id % 11 = 7) AS unrecognised
FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS line_no FROM documents) WHERE doc_id % 11 NOT IN (4, 7)"""
ORACLES["log_source_responses"] = """
SELECT mode, doc_id, sha256(text) AS text_sha256, row_number() OVER (PARTITION BY mode, doc_id % 16 ORDER BY doc_id) AS place
FROM documents, (SELECT unnest(['batch', 'stream']) AS mode) WHERE doc_id % 11 NOT IN (4, 7)"""
ORACLES["log_stream_guard"] = ORACLES["stream_fired"]
ORACLES["fixtures_read"] = """
SELECT item_id, CASE item_id % 2 WHEN 0 THEN 'bad' ELSE 'good' END AS label, sha256(text) AS text_sha256, CASE item_id % 2 WHEN 0 THEN 'EMPTY,TAIL_LOOP' ELSE '' END AS expect,
    CASE item_id % 2 WHEN 0 THEN 'han,kana' ELSE 'latin' END AS scripts, (item_id % 50)::BIGINT AS min_length FROM benchmark WHERE text IS NOT NULL"""
ORACLES["schema_contract"] = """
SELECT conv_id, turn, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE WHEN n > 0 THEN 'schema' END AS reason,
    CASE n WHEN 1 THEN 'turns.1.n: expected an integer' WHEN 2 THEN 'turns.1.n: expected an integer' WHEN 3 THEN 'turns.1.role: required' WHEN 4 THEN 'id: must not be null' END AS issues
FROM (SELECT *, (conv_id + turn) % 5 AS n FROM conversations)"""
ORACLES["scan_texts"] = "SELECT item_id, sha256(text) AS text_sha256 FROM benchmark"
ORACLES["scan_scores"] = f"""
{WHOLE_CHAT[0]}, long AS (SELECT unnest(['EMPTY', 'TOO_SHORT', 'REPETITION', 'TAIL_LOOP', 'LOW_ENTROPY']) AS code, unnest([empty, too_short, rep, tail, dense]) AS score, empty, mode FROM scored)
SELECT code, count(*) AS n, round(max(score), 6) AS worst, count(*) FILTER (empty < 1 AND mode = 'char') AS by_char FROM long WHERE empty < 1 OR code = 'EMPTY' GROUP BY code"""
ORACLES["exit_codes"] = f"""{WHOLE_CHAT[0]} SELECT source, count(*) AS checked, count(*) FILTER (len(reasons) > 0) AS degenerate, max(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END)::BIGINT AS exit_code
FROM scored JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source"""
ORACLES["written_footer"] = f"""{WHOLE_CHAT[0]}, known AS (SELECT *, doc_id % 9 <> 0 AS known FROM scored)
SELECT count(*) FILTER (known) AS lines, count(*) FILTER (known) AS checked, count(*) FILTER (known AND len(reasons) > 0) AS degenerate, count(*) FILTER (NOT known) AS unrecognised,
    max(CASE WHEN known AND len(reasons) > 0 THEN 1 ELSE 0 END)::BIGINT AS exit_code FROM known"""
_PERCENT = "floor({} * 100 + 0.5)::INTEGER"
ORACLES["check_messages"] = f"""{verdict(200, 0.35, 0.4, 0.6, 0.75)[0]}, codes AS (SELECT unnest(reasons) AS code, * EXCLUDE reasons FROM scored)
SELECT doc_id, code, CASE code WHEN 'EMPTY' THEN 'Response contains no usable content.' WHEN 'TOO_SHORT' THEN 'Response is ' || length({_T}) || ' chars, below the 200 minimum.'
    WHEN 'REPETITION' THEN {_PERCENT.format('rep')} || '% of 3-grams are duplicates.' ELSE 'Response ends in a repeating block covering ' || {_PERCENT.format('tail')} || '% of the tail.' END AS message,
    CASE code WHEN 'EMPTY' THEN 0.5 WHEN 'TOO_SHORT' THEN 0.0 WHEN 'REPETITION' THEN 0.35 WHEN 'TAIL_LOOP' THEN CASE mode WHEN 'char' THEN 0.6 ELSE 0.4 END END::DOUBLE AS threshold
FROM codes WHERE code <> 'TRUNCATED'"""
ORACLES["sql_names"] = f"""
WITH {lz('documents')}, stream AS ({ORACLES['stream_replay_first_catch']})
SELECT doc_id, round({RATIO}, 6) AS ratio, json_valid(text) AS is_json, 2 AS n_leaves, true AS found, checks,
    CASE WHEN stream.n_chars < 240 THEN -1 WHEN stream.n_chars < 300 THEN stream.n_chars ELSE least(stream.n_chars, 300 + 400 * (checks - 1)) END::BIGINT AS last_check
FROM documents JOIN stream USING (doc_id) LEFT JOIN lz ON lz.s = text[1:4000]"""
ORACLES["envelope_custom"] = """
SELECT conv_id, turn, coalesce(text, '') AS text, conv_id % 3 = 0 AS has_tool_calls, CASE WHEN turn % 4 = 1 THEN 'length' ELSE 'done' END AS stop, CASE WHEN conv_id % 3 = 0 THEN '{"q":' || turn || '}' ELSE '' END AS arguments,
    'turn ' || turn AS prompt, coalesce(text, '') AS delta, conv_id % 3 = 0 AS tool_call, CASE WHEN turn % 2 = 1 THEN CASE WHEN turn % 4 = 1 THEN 'length' ELSE 'done' END END AS event_stop FROM conversations WHERE role = 'assistant'"""
ORACLES["verdict_callbacks"] = f"{WHOLE_CHAT[0]} SELECT doc_id, len(reasons) = 0 AS ok, array_to_string(reasons, ',') AS reasons FROM scored"
