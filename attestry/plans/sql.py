"""Pieces shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

# White-space class body in RE2 syntax; the same characters as ``fixed.WS``.
WS = (
    r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def trim(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def squeeze(e: str) -> str:
    return f"regexp_replace({e}, '[{WS}]+', ' ', 'g')"


def rep(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, '{quote(pattern)}', '{quote(to)}', 'g')"


def quote(s: str) -> str:
    return s.replace("'", "''")


def count(e: str, pattern: str) -> str:
    return f"len(regexp_extract_all({e}, '{quote(pattern)}'))"


def chars(e: str, char_class: str) -> str:
    """Number of code points of ``e`` inside a class body."""
    return f"(length({e}) - length(regexp_replace({e}, '[{char_class}]', '', 'g')))"


def utf16(e: str) -> str:
    return rf"(length({e}) + length(regexp_replace({e}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def js_round(e: str, digits: int = 4) -> str:
    return f"(floor(round(({e})::DOUBLE, 10) * 1e{digits} + 0.5) / 1e{digits})::DOUBLE"


def words(e: str) -> str:
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}]+')"


def text_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{quote(v)}'" for v in values) + "]"


def content_tokens(e: str) -> str:
    from attestry import fixed

    stop = text_list(fixed.CONTENT_STOP_WORDS)
    return (
        f"list_distinct(list_filter({words(e)}, lambda t: length(t) >= 2 "
        f"AND NOT list_contains({stop}, t)))"
    )


# --- documents after normalisation --------------------------------------------------------------
_NORM = [
    ("unicode:NFC", "nfc_normalize(t)"),
    ("strip:BOM", rep("t", r"\A\x{FEFF}")),
    ("newlines:LF", rep("t", r"\r\n?", "\n")),
    ("strip:zero-width", rep("t", r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]")),
    ("strip:soft-hyphen", rep("t", r"\x{00AD}")),
    ("strip:control-chars", rep("t", r"[\x{0000}-\x{0008}\x{000B}-\x{001F}\x{007F}-\x{009F}]")),
    (
        "whitespace:unicode-spaces",
        rep("t", r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " "),
    ),
    ("whitespace:trailing", rep("t", r"(?m)[ \t]+$")),
    ("whitespace:blank-lines", rep("t", r"\n{3,}", "\n\n")),
    ("whitespace:trim", trim("t")),
]


def normalized_ctes(source: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs ending in ``norm(doc_id, t, tr)``; ``tr`` is the audit joined by ``|``."""
    parts = [f"n0 AS (SELECT doc_id, text AS t, '' AS tr FROM ({source}))"]
    for i, (name, expr) in enumerate(_NORM, 1):
        parts.append(
            f"n{i} AS (SELECT doc_id, nx AS t, CASE WHEN nx <> t THEN tr || '|norm:{name}' "
            f"ELSE tr END AS tr FROM (SELECT *, {expr} AS nx FROM n{i - 1}))"
        )
    parts.append(f"norm AS (SELECT * FROM n{len(_NORM)})")
    return ",\n".join(parts)


def cleaned_ctes() -> str:
    """CTEs from ``norm`` to ``cleaned(doc_id, t, tr)``, written with unnest and windows."""

    def fold(i: int, name: str, inner: str) -> str:
        return (
            f"c{i} AS (SELECT doc_id, CASE WHEN k > 0 THEN nx ELSE t END AS t, "
            f"CASE WHEN k > 0 THEN tr || '|clean:{name}(' || k || ')' ELSE tr END AS tr "
            f"FROM ({inner}))"
        )

    def line_filter(prev: str, keep: str) -> str:
        return (
            f"SELECT p.doc_id, p.t, p.tr, coalesce(string_agg(line, chr(10) ORDER BY pos) "
            f"FILTER (WHERE {keep}), '') AS nx, count(*) FILTER (WHERE NOT ({keep})) AS k "
            f"FROM {prev} p, (SELECT doc_id AS d, unnest(ls) AS line, "
            f"generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, "
            f"string_split(t, chr(10)) AS ls FROM {prev})) l "
            f"WHERE l.d = p.doc_id GROUP BY p.doc_id, p.t, p.tr"
        )

    page = (
        rf"(?i)^[{WS}]*(?:-[{WS}]*)?(?:trang|page|p\.)?[{WS}]*[0-9]+[{WS}]*"
        rf"(?:/[{WS}]*[0-9]+|of[{WS}]+[0-9]+|-|—)?[{WS}]*\z"
    )
    tl = trim("line")
    noise = chars(tl, rf"^\p{{L}}\p{{N}}{WS}")
    ocr_keep = (
        f"{utf16(tl)} < 4 OR regexp_matches({tl}, '^(-{{3,}}|\\*{{3,}}|_{{3,}}|={{3,}})\\z') "
        rf"OR regexp_matches({tl}, '^[|>#\-*+0-9.){WS}]+\z') "
        f"OR {noise}::DOUBLE / {utf16(tl)} <= 0.4"
    )
    repeated = (
        "SELECT p.doc_id, p.t, p.tr, string_agg(line, chr(10) ORDER BY pos) "
        "FILTER (WHERE keep) AS nx, count(*) FILTER (WHERE NOT keep) AS k FROM c1 p, ("
        "SELECT doc_id AS d, line, pos, NOT (short AND copies >= 3 AND rn > 1) AS keep FROM ("
        "SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS copies, "
        "row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS rn, "
        f"key <> '' AND {utf16('key')} <= 80 AND NOT starts_with(key, '#') AS short FROM ("
        f"SELECT doc_id, line, pos, {tl} AS key FROM (SELECT doc_id, unnest(ls) AS line, "
        "generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(t, chr(10)) AS ls "
        "FROM c1))))) l WHERE l.d = p.doc_id GROUP BY p.doc_id, p.t, p.tr"
    )
    paragraphs = (
        "SELECT p.doc_id, p.t, p.tr, string_agg(para, chr(10) || chr(10) ORDER BY pos) "
        "FILTER (WHERE keep) AS nx, count(*) FILTER (WHERE NOT keep) AS k FROM c5 p, ("
        "SELECT doc_id AS d, para, pos, NOT (nm <> '' AND nm = coalesce(lag(nm) OVER "
        "(PARTITION BY doc_id ORDER BY pos), '')) AS keep FROM ("
        f"SELECT doc_id, para, pos, {squeeze(trim('para'))} AS nm FROM (SELECT doc_id, "
        "unnest(ps) AS para, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, "
        r"string_split_regex(t, '\n{2,}') AS ps FROM c5)))) l "
        "WHERE l.d = p.doc_id GROUP BY p.doc_id, p.t, p.tr"
    )

    def plain(prev: str, pattern: str, to: str) -> str:
        return f"SELECT *, {rep('t', pattern, to)} AS nx, {count('t', pattern)} AS k FROM {prev}"

    comments, links, escapes = (
        r"<!--(?s:.*?)-->", rf"\[\]\([{WS}]*\)", r"\\([_*\[\]()#+\-.!`])"
    )
    one, two = rep("t", comments), rep(rep("t", comments), links)
    noise_step = (
        f"SELECT *, {rep(two, escapes, chr(92) + '1')} AS nx, {count('t', comments)} + "
        f"{count(one, links)} + {count(two, escapes)} AS k FROM c6"
    )
    steps = [
        fold(1, "remove:page-numbers",
             line_filter("norm", f"NOT (regexp_matches(line, '{page}') AND {tl} <> '')")),
        fold(2, "remove:repeated-headers-footers", repeated),
        fold(3, "fix:hyphenated-linebreaks",
             plain("c2", r"(\p{L})-\n(\p{L})", r"\1\2")),
        fold(4, "fix:broken-lines", plain("c3", r"(\p{Ll},?)\n(\p{Ll})", r"\1 \2")),
        fold(5, "remove:ocr-artifact-lines", line_filter("c4", ocr_keep)),
        fold(6, "remove:duplicate-paragraphs", paragraphs),
        fold(7, "remove:markdown-noise", noise_step),
        fold(8, "whitespace:collapse-spaces", plain("c7", r"[ \t]{2,}", " ")),
        fold(9, "whitespace:blank-lines", plain("c8", r"\n{3,}", "\n\n")),
        f"cleaned AS (SELECT doc_id, {trim('t')} AS t, tr FROM c9)",
    ]
    return ",\n".join(steps)


def quality_ctes(threshold: float = 0.7) -> str:
    """From ``cleaned`` to ``scored``: statistics, issues (bit string), score and validity."""
    grams = (
        "list_transform(range(1, len(ws) - 6), "
        "lambda i: lower(array_to_string(list_slice(ws, i, i + 7), ' ')))"
    )
    return rf"""stats AS (
  SELECT doc_id, t, tr, chars, len(ws) AS words,
    CASE WHEN chars = 0 THEN 0 ELSE len(string_split(t, chr(10))) END AS lines,
    CASE WHEN chars = 0 THEN 0.0::DOUBLE ELSE alpha::DOUBLE / chars END AS alpha_ratio,
    CASE WHEN chars = 0 THEN 0.0::DOUBLE
         ELSE (chars - alpha - digits - spaces)::DOUBLE / chars END AS symbol_ratio,
    repl AS replacement_chars,
    CASE WHEN len(ws) < 32 THEN 0.0::DOUBLE
         ELSE 1.0::DOUBLE - len(list_distinct(gr))::DOUBLE / len(gr) END AS repetition_ratio
  FROM (SELECT *, {grams} AS gr FROM (
    SELECT doc_id, t, tr, {utf16('t')} AS chars,
      list_filter(string_split_regex(t, '[{WS}]+'), lambda w: w <> '') AS ws,
      {chars('t', chr(92) + 'p{L}')} AS alpha, {chars('t', chr(92) + 'p{N}')} AS digits,
      {chars('t', WS)} AS spaces, {chars('t', chr(92) + 'x{FFFD}')} AS repl
    FROM cleaned))),
rules AS (
  SELECT *, chars = 0 AS r1, chars > 0 AND chars < 40 AS r2, chars >= 40 AND chars < 200 AS r3,
    replacement_chars > 0 AS r4, chars > 0 AND alpha_ratio < 0.5 AS r5, symbol_ratio > 0.3 AS r6,
    repetition_ratio > 0.65 AS r7
  FROM stats),
scored AS (
  SELECT *, NOT (r1 OR r2 OR r4) AND quality_score >= {threshold} AS quality_valid FROM (
    SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(1.0::DOUBLE
      - CASE WHEN r1 THEN 1.0 ELSE 0 END::DOUBLE - CASE WHEN r2 THEN 0.6 ELSE 0 END::DOUBLE
      - CASE WHEN r3 THEN 0.15 ELSE 0 END::DOUBLE - CASE WHEN r4 THEN 0.7 ELSE 0 END::DOUBLE
      - CASE WHEN r5 THEN 0.35 ELSE 0 END::DOUBLE - CASE WHEN r6 THEN 0.3 ELSE 0 END::DOUBLE
      - CASE WHEN r7 THEN 0.25 ELSE 0 END::DOUBLE, 3))) AS quality_score,
      array_to_string(list_filter([CASE WHEN r1 THEN 'EMPTY_DOCUMENT' END,
        CASE WHEN r2 THEN 'TOO_SHORT' END, CASE WHEN r3 THEN 'SHORT_DOCUMENT' END,
        CASE WHEN r4 THEN 'BROKEN_ENCODING' END, CASE WHEN r5 THEN 'OCR_NOISE' END,
        CASE WHEN r6 THEN 'EXCESSIVE_SYMBOLS' END,
        CASE WHEN r7 THEN 'DUPLICATE_CONTENT' END], lambda x: x IS NOT NULL), ',') AS issues
    FROM rules))"""


def gate_ctes() -> str:
    """From ``scored`` to ``gated``: duplicates among passing rows, then status."""
    return rf"""hashed AS (
  SELECT s.*, d.lang, d.source, sha256(d.text) AS checksum,
    sha256({trim(squeeze('lower(s.t)'))}) AS normalized_hash
  FROM scored s JOIN documents d USING (doc_id)),
firsts AS (
  SELECT *, min(CASE WHEN quality_valid THEN doc_id END) OVER (PARTITION BY checksum) AS fx,
    min(CASE WHEN quality_valid THEN doc_id END) OVER (PARTITION BY normalized_hash) AS fn
  FROM hashed),
gated AS (
  SELECT *, CASE WHEN fx < doc_id AND quality_valid THEN fx END AS exact_duplicate_of,
    CASE WHEN fn < doc_id AND quality_valid AND NOT coalesce(fx < doc_id, false) THEN fn END
      AS near_duplicate_of,
    CASE WHEN quality_valid AND NOT coalesce(fx < doc_id, false) THEN 'VALIDATING'
         ELSE 'REJECTED' END AS status,
    CASE WHEN NOT quality_valid THEN 'LOW_QUALITY'
         WHEN fx < doc_id THEN 'EXACT_DUPLICATE' END AS rejected_reason
  FROM firsts)"""
