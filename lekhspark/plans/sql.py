"""Fragments of SQL shared by the statements the queries are held against. They state every pattern anew and import none of the engine's."""

from __future__ import annotations

WS, NOT_WS = r"[\s\p{Z}\x{85}]", r"[^\s\p{Z}\x{85}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def chars(x: str, case: str) -> str:
    """Each character ``c`` of a text through the branches of a CASE."""
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE {case} ELSE c END), '')"


def trim(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def blank(x: str) -> str:
    return f"({x} IS NULL OR {trim(x)} = '')"


def non_blank(x: str) -> str:
    return f"CASE WHEN NOT {blank(x)} THEN {x} END"


def collapse(x: str) -> str:
    return trim(sub(sub(sub(x, r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def html(x: str) -> str:
    """Scripts and styles, short codes and comments go; line breaks, list items and blocks leave their marks; then every tag is a blank, then references."""
    x = f"coalesce({x}, '')"
    for name in ("script", "style"):
        x = sub(x, f"(?is)<{name}.*?>.*?</{name}>", " ")
    x = sub(sub(x, r"\[[^\]]+\]", " "), "(?s)<!--.*?-->", " ")
    x = sub(sub(x, r"(?i)<br\s*/?\s*>", " \n "), r"(?i)<li(\s[^>]*)?>", " \n- ")
    x = sub(sub(x, r"(?i)<(p|div|h[1-6])(\s[^>]*)?>", " \n\n "), "<[a-zA-Z/!][^>]*>", " ")
    for name, code in (("nbsp", 160), ("hellip", 8230), ("ldquo", 8220), ("rdquo", 8221), ("lsquo", 8216), ("rsquo", 8217), ("ndash", 8211), ("mdash", 8212), ("quot", 34), ("lt", 60), ("gt", 62), ("amp", 38)):
        x = f"replace({x}, '&{name};', chr({code}))"
    return collapse(x)


def normal(x: str) -> str:
    """The normal form of a text that is not blank."""
    x = collapse(f"replace(replace(replace(replace({x}, chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), '')")
    return sub(sub(x, f"{WS}+([।,;:!?])", r"\1"), rf"([।,;:!?])({NOT_WS})", r"\1 \2")


_NUKTA = " ".join(f"WHEN c = chr({code}) THEN '{letter}' || chr(2364)" for code, letter in zip(range(0x958, 0x960), "कखगजडढफय"))


def nfkc(x: str) -> str:
    """Repaired quotes and line ends, then compatibility forms: wide and sans-serif letters, ligatures, kinds of space, letters with a nukta."""
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    case = """WHEN unicode(c) BETWEEN 8216 AND 8219 THEN chr(39) WHEN unicode(c) BETWEEN 8220 AND 8223 THEN chr(34)
        WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) BETWEEN 120224 AND 120249 THEN chr(unicode(c) - 120159)
        WHEN unicode(c) BETWEEN 120250 AND 120275 THEN chr(unicode(c) - 120153) WHEN unicode(c) IN (160, 8239, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' '
        WHEN unicode(c) IN (8232, 8233, 133) THEN chr(10) WHEN unicode(c) = 64257 THEN 'fi' WHEN unicode(c) = 64258 THEN 'fl' WHEN unicode(c) = 8230 THEN '...' """
    return f"nfc_normalize({chars(x, case + _NUKTA)})"


def normal_or_blank(x: str) -> str:
    return f"CASE WHEN {blank(x)} THEN '' ELSE {normal(nfkc(x))} END"


def clean_token(x: str) -> str:
    """Lower case, decomposed, without accents, nukta and virama."""
    bare = chars(nfkc(f"lower({trim(x)})"), "WHEN unicode(c) IN (2364, 2381, 2492, 2509) THEN '' WHEN unicode(c) BETWEEN 192 AND 591 THEN strip_accents(c)")
    return f"CASE {bare} WHEN 'training & facilitation' THEN 'training and facilitation' WHEN 't&f' THEN 'training and facilitation' ELSE {bare} END"


def pipe(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '|'), lambda x: {trim('x')}), lambda x: x <> '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def roman_index(x: str) -> str:
    x = sub(sub(f"lower(coalesce({x}, ''))", r"[^a-z0-9\s]+", " "), r"\s+", " ")
    for vowel in "aiueo":
        x = sub(x, vowel + "{2,}", vowel)
    x = sub(f"replace({x}, 'v', 'w')", r"\b(yojna|yojana|yojnaa)\b", "yojana")
    return f"trim({sub(x, r'\s+', ' ')})"


def roman_loose(x: str) -> str:
    blank_if_null = f"coalesce({x}, '')"
    x = sub(f"lower({trim(blank_if_null)})", f"{WS}+", " ")
    for vowel in "aeiou":
        x = sub(x, f"{vowel}{vowel}+", vowel * 2)
    return x


def hk(x: str) -> str:
    """Devanagari in Latin letters: chr(2) stands for a consonant's own vowel until a sign, led by chr(1), takes its place."""
    x = f"replace({chars(x, _NUKTA)}, chr(2364), '')"
    for c, letter in ((0x929, "न"), (0x931, "र"), (0x934, "ळ")):
        x = f"replace({x}, chr({c}), '{letter}')"
    for c, r in zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh G c ch j jh J T Th D Dh N t th d dh n p ph b bh m y r l v z S s h L".split()):
        x = f"replace({x}, '{c}', '{r}' || chr(2))"
    signs = [*zip(range(0x93E, 0x945), "A i I u U R RR".split()), (0x962, "lR"), (0x963, "lRR"), (0x947, "e"), (0x948, "ai"), (0x94B, "o"), (0x94C, "au"), (0x94D, "")]
    for c, r in signs:
        x = f"replace({x}, chr({c}), chr(1) || '{r}')"
    for c, r in zip("अआइईउऊऋॠऌॡएऐओऔ", "a A i I u U R RR lR lRR e ai o au".split()):
        x = f"replace({x}, '{c}', '{r}')"
    for c, r in ((0x902, "M"), (0x903, "H"), (0x901, "~"), (0x93D, "''"), (0x964, "|"), (0x965, "||"), (0x950, "OM"), *((0x966 + d, str(d)) for d in range(10))):
        x = f"replace({x}, chr({c}), '{r}')"
    return f"replace(replace(replace({x}, chr(2) || chr(1), ''), chr(1), ''), chr(2), 'a')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), {lit(r'[^\p{L}\p{N}_\x{0900}-\x{097F}]+')}), lambda t: length(t) >= 2)"


def mode(x: str) -> str:
    n = f"length({x})"
    dev, latin = (f"(CASE WHEN {blank(x)} THEN 0 ELSE {count(x, p)}::DOUBLE / {n} END > 0.02)" for p in (r"\p{Devanagari}", r"\p{Latin}"))
    return f"CASE WHEN {dev} AND {latin} THEN 'mixed' WHEN {dev} THEN 'dev' ELSE 'roman' END"


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10) || chr(10)), lambda p: {trim('p')}), lambda p: p <> '')"


def joined(*xs: str) -> str:
    return "concat_ws(chr(10) || chr(10), " + ", ".join(f"CASE WHEN NOT {blank(x)} THEN {trim(x)} END" for x in xs) + ")"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {lit(WS + '+')}), lambda t: t <> '')"


def n_words(x: str) -> str:
    return count(f"coalesce({x}, '')", NOT_WS + "+")


def sentences(x: str) -> str:
    """Parts by each separator in turn; those by danda, question and exclamation mark get it back behind every part."""
    t = trim(f"coalesce({x}, '')")
    parts = f"CASE WHEN {t} = '' THEN [] ELSE [{t}] END"
    for i, (sep, tail) in enumerate((("।", "।"), ("?", "?"), ("!", "!"), ("\n", ""), (";", ""), (":", ""))):
        segs = f"list_filter(list_transform(string_split(p{i}, {lit(sep)}), lambda s{i}: {trim(f's{i}')}), lambda s{i}: s{i} <> '')"
        parts = f"flatten(list_transform({parts}, lambda p{i}: CASE WHEN len({segs}) <= 1 THEN [p{i}] ELSE list_transform({segs}, lambda u{i}: u{i} || {lit(tail)}) END))"
    return f"list_filter(list_transform({parts}, lambda z: {trim('z')}), lambda z: z <> '')"


def windows(x: str) -> str:
    """The text if it has 384 words or fewer, else windows of 384 that overlap by 40; none for a blank text."""
    n, w = n_words(x), words(x)
    return f"CASE WHEN {n} = 0 THEN [] WHEN {n} <= 384 THEN [{trim(x)}] ELSE list_transform(range(0, {n}, 344), lambda a: array_to_string(list_slice({w}, a + 1, a + 384), ' ')) END"


def packed(base: str) -> str:
    """CTEs up to ``packed`` (id, grp, part, win, chunk): paragraphs of ``base`` (id, ps) packed up to 200 words, larger ones split on their own."""
    return f"""p AS (SELECT id, i, ps[i] AS p, {n_words('ps[i]')} AS n FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM {base})),
    r AS (SELECT id, i, p, n, CASE WHEN n > 200 THEN 0 ELSE n END AS held, n > 200 AS own, 1 AS grp FROM p WHERE i = 1
      UNION ALL SELECT p.id, p.i, p.p, p.n, CASE WHEN p.n > 200 THEN 0 WHEN NOT r.own AND r.held + p.n <= 200 THEN r.held + p.n ELSE p.n END, p.n > 200,
        CASE WHEN p.n <= 200 AND NOT r.own AND r.held + p.n <= 200 THEN r.grp ELSE r.grp + 1 END FROM r JOIN p ON p.id = r.id AND p.i = r.i + 1),
    parts AS (SELECT id, grp, 0 AS part, string_agg(p, chr(10) || chr(10) ORDER BY i) AS chunk FROM r WHERE NOT own GROUP BY id, grp
      UNION ALL SELECT id, grp, k AS part, ss[k] AS chunk FROM (SELECT id, grp, ss, unnest(range(1, len(ss) + 1)) AS k FROM (SELECT id, grp, {sentences('p')} AS ss FROM r WHERE own))),
    packed AS (SELECT id, grp, part, w AS win, ws[w] AS chunk FROM (SELECT id, grp, part, ws, unnest(range(1, len(ws) + 1)) AS w FROM (SELECT id, grp, part, {windows('chunk')} AS ws FROM parts)))"""


def iso(x: str) -> str:
    """A date of the export: year first, or month first between slashes (day first where the month would be over 12), or the month's name."""
    t = f"trim({x})"
    zone = f"CASE WHEN {t} LIKE '%Z' THEN '+00:00' ELSE '' END"
    ts = "coalesce(" + ", ".join(f"try_strptime({t}, '{f}')" for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%B %d, %Y")) + ")"
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || {zone}"


def epoch(x: str) -> str:
    """Seconds of an ISO text in UTC, 0 where there is none."""
    return f"coalesce(epoch(try_strptime(substring({x}, 1, 19), '%Y-%m-%dT%H:%M:%S'))::BIGINT, 0)"


def embedded(name: str, source: str) -> str:
    """CTEs up to ``name`` (key, v): vectors of the default model for the texts of ``source`` (key, t), counts of words and letter triples, each hashed to a place and a sign."""
    return f"""{name}_w AS (SELECT key, unnest(list_filter(regexp_split_to_array(lower(coalesce(t, '')), {lit(WS + '+')}), lambda x: x <> '')) AS w FROM {source}),
    {name}_f AS (SELECT w, unnest(list_distinct(list_concat([w], list_transform(range(1, length(w) + 1), lambda i: substring('<' || w || '>', i, 3))))) AS f FROM (SELECT DISTINCT w FROM {name}_w)),
    {name}_h AS (SELECT w, (('0x' || substring(sha1(f), 1, 12))::UBIGINT % 64)::INT AS d, CASE WHEN ('0x' || substring(sha1(f), 13, 2))::INT % 2 = 1 THEN 1 ELSE -1 END AS s FROM {name}_f),
    {name}_c AS (SELECT key, d, sum(s)::DOUBLE AS x FROM {name}_w JOIN {name}_h USING (w) GROUP BY key, d),
    {name}_n AS (SELECT key, sqrt(sum(x * x)) AS n FROM {name}_c GROUP BY key),
    {name}_d AS (SELECT k.key, g.d, coalesce(c.x, 0) / n AS x FROM {name}_n k CROSS JOIN (SELECT unnest(range(0, 64))::INT AS d) g LEFT JOIN {name}_c c ON c.key = k.key AND c.d = g.d WHERE n > 0),
    {name} AS (SELECT key, list(x::FLOAT ORDER BY d) AS v FROM {name}_d GROUP BY key)"""


def unit_vectors(table: str, key: str, extra: str = "") -> str:
    """One row per key of a vector table whose vector has a length."""
    more = f", any_value({extra}) AS {extra}" if extra else ""
    return f"""(SELECT {key} AS key, any_value(vector) AS v{more} FROM {table}
      WHERE {key} IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY {key})"""
