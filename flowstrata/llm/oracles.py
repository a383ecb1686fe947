"""SQL checks of the training-data queries, where SQL can express them."""

from __future__ import annotations

from . import collocations, license_scan, line_templates, url_filter


def _url_filter() -> str:
    host = "regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*')"
    tail = f"substr(url, strpos(url, '://') + 3 + length({host}))"
    fits = []
    for verdict, name, path in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])):
        fits.append((f"(host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{path}')", name + path, verdict))

    def found(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    def listed(terms) -> str:
        return "concat_ws(',', " + ", ".join(f"CASE WHEN {found(t)} THEN '{t}' END" for t in sorted(terms)) + ")"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
      WITH parts AS (
        SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
               CASE WHEN strpos(url, '://') > 0 THEN translate({host}, '{upper}', '{lower}') ELSE '' END AS host,
               CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({tail}, '^[^?#]*') ELSE '' END AS path
        FROM pages),
      terms AS (
        SELECT *, {listed(url_filter.STRICT)} AS strict_terms, {listed(url_filter.SOFT)} AS soft_terms FROM parts),
      ruled AS (
        SELECT *, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)} END AS rule,
               CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)}
                    WHEN strict_terms <> '' OR len(string_split(soft_terms, ',')) >= {url_filter.LIMIT} THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM terms)
      SELECT page_id, host, path, rule, verdict, strict_terms, soft_terms FROM ruled
    """


def _license_scan() -> str:
    known = {license_scan._plain(s): i for i, s in license_scan.SENTENCES.items()}
    book = ", ".join(f"('{s}', '{i}')" for s, i in known.items())
    steps, previous = [], "seq"
    for number, (name, sequence) in enumerate(license_scan.RULES):
        wanted = " " + "  ".join(sequence) + " "
        steps.append(
            f"r{number} AS (SELECT doc_id, n, ids, replace(rest, '{wanted}', '') AS rest,"
            f" CASE WHEN contains(rest, '{wanted}') AND NOT list_contains(lic, '{name}')"
            f" THEN list_append(lic, '{name}') ELSE lic END AS lic FROM {previous})"
        )
        previous = f"r{number}"
    return f"""
      WITH book(sentence, id) AS (VALUES {book}),
      plain AS (
        SELECT row_number() OVER () AS row, doc_id,
               regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^a-z0-9.!?:;+\\n-]+', ' ', 'g') AS text FROM documents),
      marked AS (SELECT row, doc_id, regexp_replace(text, '[.!?:;]+ |[.!?:;]* ?\\n ?', chr(10), 'g') AS text FROM plain),
      cut AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS sentence,
                     generate_subscripts(string_split(text, chr(10)), 1) AS place FROM marked),
      hits AS (SELECT row, list(id ORDER BY place) AS ids FROM cut JOIN book ON trim(cut.sentence, ' .!?:;') = book.sentence
               GROUP BY row),
      seq AS (
        SELECT doc_id, coalesce(len(ids), 0) AS n, coalesce(array_to_string(ids, ','), '') AS ids,
               CASE WHEN ids IS NULL THEN '' ELSE ' ' || array_to_string(ids, '  ') || ' ' END AS rest,
               CAST([] AS VARCHAR[]) AS lic
        FROM plain LEFT JOIN hits USING (row)),
      {', '.join(steps)}
      SELECT doc_id, n AS n_sentences, ids AS sentence_ids, array_to_string(lic, ',') AS licenses FROM {previous}
    """


def _line_templates() -> str:
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    lead, general, parts = line_templates.LEADING, line_templates.GENERAL_FROM, line_templates.SEGMENTS
    free = {"1": "t[first + 1:n]", "2": f"t[{lead + 1}:first]"}
    fixed = {"1": "t[1:first]", "2": f"list_concat(t[1:{lead}], t[first + 1:n])"}

    def half(kind: str) -> str:
        size = f"CAST(ceil(len({free[kind]}) / CAST({parts} AS DOUBLE)) AS BIGINT)"
        cut = ", ".join(f"array_to_string(({free[kind]})[{size} * {i} + 1:{size} * {i + 1}], ' ')" for i in range(parts))
        return (f"SELECT k, doc_id, no, n, '{kind} ' || n || ' ' || array_to_string({fixed[kind]}, ' ') AS leaf, TRUE AS half,"
                f" len(list_filter({fixed[kind]}, lambda x: x <> '<*>')) AS constant, [{cut}] AS seg FROM sized WHERE n >= {general}")

    varying = " + ".join(f"CAST(min(seg[{i + 1}]) <> max(seg[{i + 1}]) AS INT)" for i in range(parts))
    return f"""
      WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, text
                    FROM (SELECT DISTINCT doc_id, text FROM documents)),
      raw AS (SELECT k, doc_id, unnest(string_split(text, chr(10))) AS x,
                     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM docs WHERE text IS NOT NULL),
      filled AS (SELECT k, doc_id, no, regexp_replace(x, '{word}*[0-9]{word}*', '<*>', 'g') AS line FROM raw
                 WHERE regexp_matches(x, '{word}')),
      cut AS (SELECT k, doc_id, no, regexp_split_to_array(regexp_replace(line, '^{space}|{space}$', '', 'g'), '{space}') AS t
              FROM filled),
      sized AS (SELECT *, len(t) AS n, {lead} + (len(t) - {lead} + 1) // 2 AS first FROM cut),
      leaves AS (SELECT * FROM (
        SELECT k, doc_id, no, n, '0 ' || n || ' ' || array_to_string(t, ' ') AS leaf, FALSE AS half,
               len(list_filter(t, lambda x: x <> '<*>')) AS constant, ['', '', '', ''] AS seg FROM sized
        UNION ALL {half('1')} UNION ALL {half('2')}) WHERE constant > 0),
      met AS (SELECT leaf, min(doc_id) AS a, max(doc_id) AS b FROM leaves GROUP BY leaf HAVING count(DISTINCT k) > 1),
      shared AS (SELECT l.*, a, b FROM leaves l JOIN met USING (leaf)),
      totals AS (SELECT k, sum(n) AS total FROM sized GROUP BY k),
      once AS (SELECT k, no, max(n) AS n, min(a) AS a, max(b) AS b FROM shared GROUP BY k, no),
      alike AS (SELECT k, n, greatest(count(*) OVER (PARTITION BY k, a), count(*) OVER (PARTITION BY k, b)) AS lines FROM once),
      original AS (SELECT k FROM (SELECT k, sum(CASE WHEN lines > 1 THEN n ELSE 0 END) AS copied FROM alike GROUP BY k)
                   JOIN totals USING (k) WHERE copied <= total * {line_templates.COPIED}),
      templates AS (SELECT leaf FROM shared SEMI JOIN original USING (k) GROUP BY leaf HAVING CASE WHEN max(half)
          THEN (count(DISTINCT k) - 1) * max(constant) >= {line_templates.HALF_EVIDENCE} AND {varying} <= 1
          ELSE (count(DISTINCT k) - 1) * max(constant) >= {line_templates.EVIDENCE} END),
      dropped AS (SELECT DISTINCT k, no FROM leaves SEMI JOIN templates USING (leaf)),
      rest AS (SELECT raw.k, count(*) AS n_lines, count(dropped.no) AS gone,
                      coalesce(string_agg(x, chr(10) ORDER BY raw.no) FILTER (dropped.no IS NULL), '') AS kept
               FROM raw LEFT JOIN dropped ON raw.k = dropped.k AND raw.no = dropped.no GROUP BY raw.k)
      SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines,
             CASE WHEN gone > 0 AND regexp_matches(kept, '{word}') THEN gone ELSE 0 END AS n_dropped,
             CASE WHEN gone > 0 AND regexp_matches(kept, '{word}') THEN kept ELSE d.text END AS text
      FROM documents d JOIN docs ON d.doc_id IS NOT DISTINCT FROM docs.doc_id AND d.text IS NOT DISTINCT FROM docs.text
      LEFT JOIN rest USING (k)
    """


def _collocations() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(
        f"SELECT lang, {size} AS size, array_to_string(w[i:i + {size - 1}], ' ') AS phrase"
        f" FROM words, unnest(range(1, len(w) - {size} + 2)) AS g(i)" for size in (1, 2, 3)
    )
    return f"""
      WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents),
      words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
      counts AS (SELECT lang, size, phrase, count(*) AS f FROM ({grams}) GROUP BY lang, size, phrase),
      totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
      many AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= {collocations.LEAST}),
      cuts AS (
        SELECT c.lang, c.size, c.phrase, c.f AS a, k, h.f AS l, t.f AS r,
               CAST({collocations.SCALE}::HUGEINT * c.f * c.f // (h.f::HUGEINT * t.f) AS BIGINT) AS score
        FROM many c, unnest(range(1, c.size)) AS g(k), counts h, counts t
        WHERE h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ')
          AND t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
      scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
      inner_phrases AS (
        SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, f FROM many, unnest([1, 2]) AS g(i) WHERE size = 3),
      covers AS (SELECT lang, phrase, max(f) AS longer FROM inner_phrases GROUP BY lang, phrase),
      ranked AS (
        SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
        FROM scored s LEFT JOIN covers c ON c.lang = s.lang AND c.phrase = s.phrase AND s.size = 2
        WHERE c.longer IS NULL OR 100 * c.longer < {collocations.COVERED} * s.a)
      SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """


ORACLES = {
    "op1_url_filter": _url_filter(), "op2_license_scan": _license_scan(), "op9_line_templates": _line_templates(),
    "op12_collocations": _collocations(),
}
