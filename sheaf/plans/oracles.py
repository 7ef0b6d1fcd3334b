"""ANSI SQL for DuckDB that states what each registered query must return.

Written from the semantics, not from the Spark plans: chunks are unnested rows, globs are
DuckDB's own, links are followed by a recursive query that goes down level by level.
"""

from __future__ import annotations

from sheaf.plans.fixtures import EXCLUDE, INCLUDE

ORACLES: dict[str, str] = {}

_INCLUDE = [p.strip(" \t") for p in INCLUDE]
_EXCLUDE = [p.strip(" \t") for p in EXCLUDE]
_OWN = ["/corpus/out/doc_?7.md", "out/doc_?7.md", "doc_?7.md"]


def _any_glob(value: str, patterns: list[str]) -> str:
    tests = [f"lower({value}) GLOB lower('{p}')" for p in patterns if p]
    return "(" + " OR ".join(tests) + ")"


def _base(path: str = "path") -> str:
    return f"regexp_extract({path}, '[^/\\\\]*$')"


def _included(path: str = "path") -> str:
    short = f"(starts_with({path}, 'src/') AND {_any_glob(f'substr({path}, 5)', _INCLUDE)})"
    both = f"{_any_glob(_base(path), _INCLUDE)} OR {_any_glob(path, _INCLUDE)}"
    return f"(is_directory OR {both} OR {short})"


def _excluded(patterns: list[str], path: str = "path", directory: str = "is_directory") -> str:
    inside = [p + "/*" for p in patterns]
    both = f"{_any_glob(path, patterns)} OR {_any_glob(_base(path), patterns)}"
    return f"({both} OR ({directory} AND {_any_glob(path, inside)}))"


_CORPUS = """corpus AS (
  SELECT doc_id, source, lang, top || source || '/' || lang || '/' || stem || doc_id || ext AS path,
         content, octet_length(content) AS size, stem = 'link_' AS is_symlink, stem
  FROM (
    SELECT doc_id, source, lang, stem,
      CASE WHEN doc_id % 29 = 0 THEN '.git/' WHEN doc_id % 7 = 0 THEN 'src/'
           WHEN doc_id % 5 = 0 THEN 'build/' ELSE '' END AS top,
      CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.c' WHEN 3 THEN '.h'
           WHEN 4 THEN '.log' ELSE '.PY' END AS ext,
      CASE WHEN stem = 'empty_' THEN ''::BLOB
           WHEN stem = 'nul_' AND doc_id % 26 = 0 THEN '\\x00'::BLOB || encode(text)
           WHEN stem = 'nul_' THEN encode(text) || '\\x00'::BLOB
           ELSE encode(text) END AS content
    FROM (SELECT *, 'doc_' AS stem FROM documents
          UNION ALL SELECT *, 'empty_' FROM documents WHERE doc_id % 41 = 0
          UNION ALL SELECT *, 'nul_' FROM documents WHERE doc_id % 26 IN (0, 13)
          UNION ALL SELECT *, 'link_' FROM documents WHERE doc_id % 11 = 0)))"""

_PAGES = """pages_corpus AS (
  SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')
           || '/page_' || page_id || '.html' AS path, encode(html) AS content
  FROM pages)"""

_CONV = """conv AS (
  SELECT conv_id, 'conv_' || conv_id || '/' || lpad(turn::VARCHAR, 4, '0') || '_' || role || '.txt'
           AS path, text FROM conversations)"""


def _prefixes(table: str) -> str:
    return f"""dirs AS (
  SELECT DISTINCT array_to_string(parts[1:n], '/') AS path, CAST(n - 1 AS INTEGER) AS level
  FROM (SELECT parts, unnest(range(1, len(parts))) AS n
        FROM (SELECT string_split(path, '/') AS parts FROM {table})))"""


def _entries(table: str = "corpus") -> str:
    return f"""{_prefixes(table)},
entries AS (
  SELECT path, false AS is_directory, size FROM {table}
  UNION ALL SELECT path, true, 0 FROM dirs)"""


def _hidden(patterns: list[str]) -> str:
    """Directories that an excluded one hides, itself included, and every entry below them."""
    return f"""lines AS (
  SELECT path, array_to_string(parts[1:n], '/') AS above
  FROM (SELECT path, parts, unnest(range(1, len(parts))) AS n
        FROM (SELECT path, string_split(path, '/') AS parts FROM entries))),
hidden AS (SELECT DISTINCT path FROM lines WHERE {_excluded(patterns, 'above', 'true')})"""


def _chunked(table: str = "corpus") -> str:
    return f"""stepped AS (
  SELECT *, CASE WHEN size > 0 AND size < 4096 THEN size WHEN size < 16384 THEN 4096
                 ELSE 16384 END AS step FROM {table}),
chunks AS (
  SELECT path, size, step, k, content[k * step + 1 : (k + 1) * step] AS chunk
  FROM (SELECT *, unnest(range(CAST(ceil(octet_length(content) / step::DOUBLE) AS BIGINT))) AS k
        FROM stepped))"""


_NUL = "regexp_matches(hex(chunk[1:1024]), '^(..)*?00')"


def _judged(refused: str = _NUL, table: str = "corpus") -> str:
    """Whole files with what is accepted of them when chunks with ``refused`` end a file."""
    return f"""{_chunked(table)},
cuts AS (SELECT path, min(k) AS cut FROM chunks WHERE {refused} GROUP BY path),
judged AS (
  SELECT s.*, CASE WHEN cut IS NULL THEN 'ok' ELSE 'content_excluded' END AS status,
    CASE WHEN cut IS NULL THEN octet_length(content) ELSE cut * step END AS input_bytes,
    CASE WHEN cut IS NULL THEN content WHEN cut = 0 THEN ''::BLOB
         ELSE content[1 : cut * step] END AS body
  FROM stepped s LEFT JOIN cuts USING (path))"""


_KEPT = "kept AS (SELECT * FROM corpus WHERE NOT is_symlink)"
_DIGEST = "md5(body) AS md5, octet_length(body) AS bytes"
_TEXT = """encode('// File: ' || path || chr(10)) || body
  || CASE WHEN status = 'ok' THEN encode(chr(10) || chr(10)) ELSE ''::BLOB END"""
_POSITION = "row_number() OVER (ORDER BY string_split(path, '/')) AS position"
_DEPTH = "(len(string_split(path, '/')) - 1)"
_LINE = f"""repeat('  ', {_DEPTH}) || CASE WHEN is_directory THEN '📁 ' || path || '/'
  ELSE '📄 ' || %s || path END || chr(10)"""
_SIZE = "'[' || CAST((size + 1023) // 1024 AS VARCHAR) || ' KB] '"


def oracle(name: str, *parts: str, recursive: bool = False) -> None:
    *tables, last = parts
    head = "WITH RECURSIVE " if recursive else "WITH "
    ORACLES[name] = (head + ",\n".join(tables) + "\n" if tables else "") + last


oracle(
    "path_basename",
    _CORPUS,
    """raw AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(path, '/', chr(92))
                 WHEN doc_id % 10 = 1 THEN path || '/' ELSE path END AS path FROM corpus)""",
    f"SELECT doc_id, path, {_base()} AS name FROM raw",
)
oracle(
    "path_relative",
    _CORPUS,
    """SELECT doc_id, '/data/' || source AS base,
         CASE WHEN starts_with(path, source || '/') THEN substr(path, length(source) + 2) END
           AS relative FROM corpus""",
)
def _normalized(path: str) -> str:
    """``/`` and the normal path; ``!`` in front if it leads above the top."""
    return f"""list_reduce(string_split({path}, '/'), lambda kept, s: CASE WHEN s IN ('', '.') THEN kept
      WHEN s <> '..' THEN kept || '/' || s WHEN kept IN ('', '!') THEN '!' ELSE regexp_replace(kept, '/[^/]*$', '') END, '')"""


oracle(
    "path_normalize",
    _CORPUS,
    """raw AS (SELECT doc_id, source || ['/./', '//', '/x/../', '/../', '/../../', '/', '/a/b/../../..//'][doc_id % 7 + 1]
         || path || CASE WHEN doc_id % 3 = 0 THEN '/..' ELSE '/.' END AS raw FROM corpus)""",
    f"SELECT doc_id, raw, CASE WHEN NOT starts_with(n, '!') THEN substr(n, 2) END AS normalized FROM (SELECT *, {_normalized('raw')} AS n FROM raw)",
)

oracle(
    "path_join",
    _CORPUS,
    f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN {_base()} ELSE path END AS joined FROM corpus",
)
oracle("path_level", _PAGES, f"SELECT page_id, path, CAST({_DEPTH} AS INTEGER) AS level FROM pages_corpus")
oracle(
    "size_kb", _CORPUS, "SELECT doc_id, size, CAST(ceil(size / 1024.0) AS BIGINT) AS kb FROM corpus"
)
oracle(
    "byte_sizes",
    "SELECT doc_id, octet_length(encode(text)) AS bytes, length(text) AS characters FROM documents",
)
oracle(
    "is_binary",
    _CORPUS,
    """SELECT doc_id, regexp_matches(hex(content[1:8192]), '^(..)*?00') AS is_binary
       FROM corpus""",
)
oracle(
    "pattern_normalize",
    "SELECT doc_id, trim('* ' || source, ' ' || chr(9)) AS pattern FROM documents",
)
oracle(
    "corpus_pages",
    _PAGES,
    "SELECT path, octet_length(content) AS size, md5(content) AS md5 FROM pages_corpus",
)
oracle(
    "corpus_conversations",
    _CONV,
    "SELECT path, octet_length(encode(text)) AS size, md5(text) AS md5 FROM conv",
)
oracle("directories", _CORPUS, _prefixes("corpus"), "SELECT path, level FROM dirs")
oracle(
    "subtree_sizes",
    _CORPUS,
    _prefixes("corpus"),
    """SELECT d.path, count(*) AS files, CAST(sum(f.size) AS BIGINT) AS bytes
         FROM dirs d JOIN corpus f ON starts_with(f.path, d.path || '/') GROUP BY d.path
       UNION ALL SELECT '', count(*), CAST(sum(size) AS BIGINT) FROM corpus HAVING count(*) > 0""",
)
oracle(
    "subtree_intervals",
    _CORPUS,
    _prefixes("corpus"),
    """entries AS (SELECT path, false AS is_directory FROM corpus UNION ALL SELECT path, true FROM dirs),
       placed AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS enter FROM entries)""",
    """SELECT e.path, e.is_directory, e.enter, e.enter + 1 + count(b.path) AS leave
         FROM placed e LEFT JOIN placed b ON starts_with(b.path, e.path || '/') GROUP BY e.path, e.is_directory, e.enter""",
)
oracle("page_directories", _PAGES, _prefixes("pages_corpus"), "SELECT path, level FROM dirs")
oracle(
    "chunks",
    _CORPUS,
    _chunked(),
    """SELECT path, CAST(k AS INTEGER) AS chunk_no, k * step AS "offset", md5(chunk) AS md5,
         octet_length(chunk) AS bytes FROM chunks""",
)
oracle(
    "glob_match",
    _CORPUS,
    "patterns AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"({n}, '{p}')"
        for n, p in enumerate([*_INCLUDE, *_EXCLUDE, "*/DE/doc_*[!02468].?"])
    )
    + ") v(pattern_id, pattern))",
    """SELECT path, pattern_id FROM corpus JOIN patterns
         ON pattern <> '' AND lower(path) GLOB lower(pattern)""",
)
oracle(
    "include_filter",
    _CORPUS,
    _entries(),
    f"SELECT path, is_directory FROM entries WHERE {_included()}",
)
oracle(
    "exclude_filter",
    _CORPUS,
    _entries(),
    f"SELECT path, is_directory FROM entries WHERE NOT {_excluded(_EXCLUDE)}",
)
oracle(
    "include_exclude",
    _CORPUS,
    _entries(),
    f"""SELECT path, is_directory FROM entries
        WHERE {_included()} AND NOT {_excluded(_EXCLUDE)}""",
)
oracle(
    "prune_subtrees",
    _CORPUS,
    _entries(),
    _hidden(_EXCLUDE),
    f"""SELECT path, is_directory FROM entries
        WHERE NOT {_excluded(_EXCLUDE)} AND path NOT IN (SELECT path FROM hidden)""",
)
oracle(
    "self_output_exclude",
    _CORPUS,
    _entries(),
    _hidden(_OWN),
    f"""SELECT path, is_directory FROM entries
        WHERE NOT {_excluded(_OWN)} AND path NOT IN (SELECT path FROM hidden)""",
)
oracle("symlink_skip", _CORPUS, "SELECT path, size FROM corpus WHERE NOT is_symlink")
oracle(
    "size_cap",
    _CORPUS,
    _KEPT,
    _judged(table="kept"),
    """capped AS (SELECT path, size, CASE WHEN size > 8000 THEN 'too_large' ELSE status END
         AS status, CASE WHEN size > 8000 THEN ''::BLOB ELSE body END AS body FROM judged)""",
    f"""SELECT path, size, status, md5({_TEXT}) AS md5, octet_length({_TEXT}) AS bytes
        FROM capped""",
)
oracle(
    "depth_cap",
    _CORPUS,
    _entries(),
    f"SELECT path, is_directory FROM entries WHERE {_DEPTH} < 3",
)
oracle(
    "plugin_path_predicate",
    _CORPUS,
    _entries(),
    """SELECT path, is_directory FROM entries
       WHERE NOT list_contains(string_split(path, '/'), 'fr') AND (is_directory OR size % 3 <> 0)""",
)
oracle(
    "binary_skip",
    _CORPUS,
    _judged(),
    f"SELECT path, status, input_bytes, {_DIGEST} FROM judged",
)
oracle(
    "binary_include",
    _CORPUS,
    """SELECT path, 'ok' AS status, size AS input_bytes, md5(content) AS md5, size AS bytes
       FROM corpus""",
)
oracle(
    "binary_placeholder",
    _CORPUS,
    _judged(),
    """shown AS (SELECT path, octet_length(content) AS input_bytes, CASE WHEN status = 'ok'
         THEN content ELSE encode('// [Binary file content not displayed]' || chr(10)) END AS body
         FROM judged)""",
    f"SELECT path, 'ok' AS status, input_bytes, {_DIGEST} FROM shown",
)
oracle(
    "plugin_content_predicate",
    _CORPUS,
    _judged("regexp_matches(hex(chunk), '^(..)*?7A7A')"),
    f"SELECT path, status, input_bytes, {_DIGEST} FROM judged",
)
oracle(
    "content_rules",
    _CORPUS,
    _judged(
        """regexp_matches(hex(chunk), '^(..)*?40') OR NOT regexp_matches(hex(chunk), '^(..)*?7468')"""
    ),
    f"SELECT path, status, input_bytes, {_DIGEST} FROM judged",
)
oracle(
    "transform_chain",
    _CORPUS,
    _judged(),
    """steps AS (SELECT c.path, k, '<'::BLOB || chunk || '>'::BLOB AS marked
         FROM chunks c LEFT JOIN cuts USING (path) WHERE cut IS NULL OR k < cut)""",
    """ends AS (SELECT path, k, hex(CASE WHEN octet_length(marked) > 1000 THEN marked[1:1000]
         ELSE marked END || encode(chr(10))) AS piece FROM steps)""",
    "joined AS (SELECT path, unhex(string_agg(piece, '' ORDER BY k)) AS body FROM ends GROUP BY path)",
    """SELECT path, status, input_bytes, md5(coalesce(j.body, ''::BLOB)) AS md5,
         octet_length(coalesce(j.body, ''::BLOB)) AS bytes
       FROM judged LEFT JOIN joined j USING (path)""",
)

_LINKED = """linked AS (
  SELECT a.*, CASE WHEN a.is_symlink THEN coalesce(b.path, 'missing/doc_' || a.doc_id) END
    AS link_target FROM corpus a
    LEFT JOIN corpus b ON b.doc_id = a.doc_id + 1 AND b.stem = 'doc_' AND a.is_symlink)"""

oracle(
    "symlink_placeholder",
    _CORPUS,
    _LINKED,
    _judged(),
    """targets AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN repeat(link_target, 200)
         WHEN doc_id % 5 <> 1 THEN link_target END AS target FROM linked)""",
    """shown AS (SELECT path,
         CASE WHEN is_symlink THEN 'ok' ELSE status END AS status,
         CASE WHEN is_symlink THEN 0 ELSE input_bytes END AS input_bytes,
         CASE WHEN NOT is_symlink THEN body
           WHEN target IS NULL THEN encode('// [Symbolic link - target unreadable]' || chr(10))
           WHEN strlen(target) + 24 >= 2048
             THEN encode('// [Symbolic link - target too long]' || chr(10))
           ELSE encode('// [Symbolic link to: ' || target || ']' || chr(10)) END AS body
         FROM judged JOIN targets USING (path))""",
    f"SELECT path, status, input_bytes, {_DIGEST} FROM shown",
)
oracle(
    "symlink_include",
    _CORPUS,
    _LINKED,
    """seen AS (SELECT l.path, l.is_symlink,
         CASE WHEN l.is_symlink THEN strlen(l.link_target) ELSE l.size END AS size,
         CASE WHEN l.is_symlink THEN t.content ELSE l.content END AS content
         FROM linked l LEFT JOIN corpus t ON l.link_target = t.path)""",
    _judged(table="seen"),
    """SELECT path, is_symlink, size,
         CASE WHEN content IS NULL THEN 'unreadable' ELSE status END AS status,
         coalesce(input_bytes, 0) AS input_bytes, md5(body) AS md5, octet_length(body) AS bytes
       FROM judged""",
)
oracle("dfs_order", _CORPUS, _entries(), f"SELECT path, {_POSITION} FROM entries")
oracle(
    "structure_listing",
    _CORPUS,
    _KEPT,
    _entries("kept"),
    _hidden(_EXCLUDE),
    f"""SELECT path, {_LINE % "''"} AS text, {_POSITION} FROM entries
        WHERE {_included()} AND NOT {_excluded(_EXCLUDE)}
          AND path NOT IN (SELECT path FROM hidden)""",
)
oracle(
    "structure_listing_sizes",
    _CORPUS,
    _KEPT,
    _entries("kept"),
    f"SELECT path, {_LINE % _SIZE} AS text, {_POSITION} FROM entries",
)
oracle(
    "file_fragments",
    _CORPUS,
    _KEPT,
    _judged(table="kept"),
    f"SELECT path, status, md5({_TEXT}) AS md5, octet_length({_TEXT}) AS bytes FROM judged",
)


def _parts(frame: str, line: str, text: str, where: str) -> str:
    return f"""parts AS (
  SELECT * FROM (VALUES {frame}) f(section, path, text)
  UNION ALL SELECT 1, path, encode({line}) FROM entries WHERE {where}
  UNION ALL SELECT 3, path, {text} FROM judged JOIN entries USING (path) WHERE {where})"""


def _document(*parts: str) -> list[str]:
    return [
        _parts(*parts),
        """SELECT section, md5(text) AS md5, octet_length(text) AS bytes,
             row_number() OVER (ORDER BY section, string_split(path, '/')) AS position FROM parts""",
    ]


_TEXT_DOCUMENT = (
    """(0, '', encode('Directory Structure:' || chr(10) || '==================' || chr(10) || chr(10))),
           (2, '', encode(chr(10) || 'File Contents:' || chr(10) || '=============' || chr(10) || chr(10)))""",
    _LINE % _SIZE,
    _TEXT,
    f"{_included()} AND NOT {_excluded(_EXCLUDE)} AND path NOT IN (SELECT path FROM hidden)",
)
oracle(
    "render_text",
    _CORPUS,
    _KEPT,
    _entries("kept"),
    _hidden(_EXCLUDE),
    _judged(table="kept"),
    *_document(*_TEXT_DOCUMENT),
)
oracle(
    "document_index",
    _CORPUS,
    _KEPT,
    _entries("kept"),
    _hidden(_EXCLUDE),
    _judged(table="kept"),
    _parts(*_TEXT_DOCUMENT),
    """SELECT section, path, md5(text) AS md5, octet_length(text) AS bytes,
         CAST(coalesce(sum(octet_length(text)) OVER (ORDER BY section, string_split(path, '/')
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM parts""",
)
oracle(
    "custom_format",
    _CORPUS,
    _KEPT,
    _entries("kept"),
    _judged(table="kept"),
    """pieces AS (SELECT path, unhex(string_agg('7E7E7E0A' || hex(chunk) || '0A7E7E7E0A', ''
         ORDER BY k)) AS shown FROM chunks GROUP BY path)""",
    """marked AS (SELECT j.path, j.size, CASE WHEN status <> 'ok' THEN
         encode('~~~' || chr(10) || '// [Binary file content not displayed]' || chr(10) || chr(10)
                || '~~~' || chr(10))
         ELSE coalesce(shown, ''::BLOB) END AS body FROM judged j LEFT JOIN pieces USING (path))""",
    """parts AS (
         SELECT * FROM (VALUES
           (0, '', encode('# Corpus' || chr(10) || chr(10) || '## Files' || chr(10) || chr(10))),
           (2, '', encode(chr(10) || '## Contents' || chr(10) || chr(10))),
           (4, '', encode('----' || chr(10) || 'end' || chr(10)))) f(section, path, text)
         UNION ALL SELECT 1, path, encode(CASE WHEN is_directory THEN '- **' || path || '**'
           ELSE '- ' || path || ' at ' || (len(string_split(path, '/')) - 1) END || chr(10))
           FROM entries
         UNION ALL SELECT 3, path, encode('### ' || path || ' ' || size || chr(10)) || body
           || encode(chr(10)) FROM marked)""",
    """SELECT section, md5(text) AS md5, octet_length(text) AS bytes,
         row_number() OVER (ORDER BY section, string_split(path, '/')) AS position FROM parts""",
)
for _name in ("render_json", "render_json_blocks"):
    oracle(
        _name,
        _CORPUS,
        _KEPT,
        _judged(table="kept"),
        """SELECT path, size, coalesce(TRY(decode(body)), to_base64(body)) AS content,
             CASE WHEN TRY(decode(body)) IS NULL THEN 'base64' END AS encoding FROM judged""",
    )
oracle(
    "bundle_by_source",
    _CORPUS,
    _KEPT,
    _judged(table="kept"),
    f"texts AS (SELECT source, path, size, {_TEXT} AS text FROM judged)",
    """placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source
         ORDER BY string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         // 65536 AS volume FROM texts)""",
    """volumes AS (SELECT source, CAST(volume AS BIGINT) AS volume, count(*) AS files,
         unhex(string_agg(hex(text), '' ORDER BY string_split(path, '/'))) AS body
         FROM placed GROUP BY source, volume)""",
    f"SELECT source, volume, files, {_DIGEST} FROM volumes",
)
oracle(
    "bundle_conversations",
    _CONV,
    """texts AS (SELECT conv_id, path, strlen(text) AS size, '// File: ' || path || chr(10) || text || chr(10) || chr(10)
         AS text FROM conv)""",
    """placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id
         ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1024 AS volume
         FROM texts)""",
    """SELECT conv_id, CAST(volume AS BIGINT) AS volume, count(*) AS files,
         string_agg(text, '' ORDER BY path) AS text FROM placed GROUP BY conv_id, volume""",
)

# The tree with links, and one recursive query per question: where a chain of links ends, and
# what a walk that enters directories one by one lists.
_TREE = """named AS (SELECT *, CAST(substr(source, 4) AS BIGINT) AS n FROM (
    SELECT source, min(doc_id) AS first, arg_min(lang, doc_id) AS lang
    FROM documents GROUP BY source)),
links AS (
  SELECT DISTINCT source || '/' || lang AS parent, 'back' AS name, source AS target FROM documents
  UNION ALL SELECT source, 'self', source || '/self' FROM named
  UNION ALL SELECT source, 'lost', 'missing/' || source FROM named
  UNION ALL SELECT source, 'first', source || '/' || lang || '/doc_' || first || '.txt' FROM named
  UNION ALL SELECT source, 'next', 'src' || (n + 1) FROM named WHERE n % 4 = 0
  UNION ALL SELECT source, 'twin', 'src' || (n + 1) FROM named WHERE n % 4 = 0
  UNION ALL SELECT source, 'hop', 'src' || (n + 1) || '/hop2' FROM named WHERE n % 4 = 1
  UNION ALL SELECT source, 'hop2', 'src' || (n + 1) || '/en' FROM named WHERE n % 4 = 2
  UNION ALL SELECT source, 'up', 'src' || (n - 2) FROM named WHERE n % 4 = 3
  UNION ALL SELECT source, 'via', source || '/next/en' FROM named WHERE n % 4 = 0
  UNION ALL SELECT source, 'beyond', source || '/twin/en/back/' || lang FROM named WHERE n % 4 = 0),
plain AS (
  SELECT source || '/' || lang AS parent, 'doc_' || doc_id || '.txt' AS name, false AS is_directory,
         octet_length(encode(text)) AS size FROM documents
  UNION ALL SELECT DISTINCT source, lang, true, 0 FROM documents
  UNION ALL SELECT DISTINCT '', source, true, 0 FROM documents),
places AS (SELECT CASE WHEN parent = '' THEN name ELSE parent || '/' || name END AS path, * FROM plain),
hops AS (
  SELECT parent || '/' || name AS path, target, 1 AS hop FROM links
  UNION ALL SELECT h.path, l.target || substr(h.target, length(l.parent || '/' || l.name) + 1), hop + 1
    FROM hops h JOIN links l ON (h.target = l.parent || '/' || l.name
      OR starts_with(h.target, l.parent || '/' || l.name || '/')) WHERE hop < 40),
ends AS (SELECT h.path, p.path AS target, p.is_directory, p.size FROM hops h JOIN places p
  ON h.target = p.path),
children AS (
  SELECT parent, name, path AS physical, is_directory, false AS is_symlink, size FROM places
  UNION ALL SELECT l.parent, l.name,
    CASE WHEN e.is_directory THEN e.target ELSE l.parent || '/' || l.name END,
    coalesce(e.is_directory, false), true, coalesce(e.size, strlen(l.target))
  FROM links l LEFT JOIN ends e ON e.path = l.parent || '/' || l.name),
walk AS (
  SELECT name AS path, physical, is_directory, is_symlink, size, false AS is_cycle, [''] AS entered
  FROM children WHERE parent = ''
  UNION ALL
  SELECT w.path || '/' || c.name, c.physical, c.is_directory, c.is_symlink, c.size,
    c.is_directory AND list_contains(list_append(w.entered, w.physical), c.physical),
    list_append(w.entered, w.physical)
  FROM walk w JOIN children c ON c.parent = w.physical
  WHERE w.is_directory AND NOT w.is_cycle)"""

oracle(
    "symlink_follow",
    _TREE,
    f"SELECT path, is_directory, is_symlink, size, CAST({_DEPTH} AS INTEGER) AS level FROM walk",
    recursive=True,
)
oracle(
    "symlink_cycles",
    _TREE,
    "SELECT path, physical AS physical_path FROM walk WHERE is_cycle",
    recursive=True,
)
oracle(
    "link_diagnostics",
    _TREE,
    """SELECT path, 'cycle' AS code, physical || ' leads back into a directory on its own way' AS message
         FROM walk WHERE is_cycle
       UNION ALL SELECT parent || '/' || name, 'unresolvable_link',
         parent || '/' || name || ' leads to nothing that is listed' FROM links
         WHERE parent || '/' || name NOT IN (SELECT path FROM ends)""",
    recursive=True,
)
oracle(
    "run_stats",
    _CORPUS,
    _KEPT,
    _judged(table="kept"),
    """pieces AS (SELECT path, count(*) FILTER (cut IS NULL OR k < cut) AS n FROM chunks
         LEFT JOIN cuts USING (path) GROUP BY path)""",
    """SELECT count(*) AS total_files,
         count(*) - count(*) FILTER (size <= 8000 AND status <> 'ok') AS processed_files,
         count(*) FILTER (size > 8000 OR status <> 'ok') AS skipped_files,
         CAST(sum(CASE WHEN size <= 8000 THEN input_bytes ELSE 0 END) AS BIGINT) AS processed_bytes,
         CAST(sum(CASE WHEN size <= 8000 THEN input_bytes + coalesce(n, 0) ELSE 0 END) AS BIGINT)
           AS filtered_bytes
       FROM judged LEFT JOIN pieces USING (path)""",
)
oracle(
    "progress_by_file",
    _CORPUS,
    _KEPT,
    _judged(table="kept"),
    "SELECT path, input_bytes AS progress_bytes FROM judged",
)

_CODES = """found AS (
  SELECT path, 'depth_exceeded' AS code, path || ' lies deeper than the run goes' AS message
    FROM linked WHERE len(string_split(path, '/')) - 1 >= 3
  UNION ALL
  SELECT l.path, 'too_large', l.path || ' has more bytes than the run takes'
    FROM linked l WHERE len(string_split(path, '/')) - 1 < 3 AND NOT is_symlink AND size > 8000
  UNION ALL
  SELECT l.path, 'unreadable', l.path || ' has no content that could be read'
    FROM linked l LEFT JOIN corpus t ON l.link_target = t.path
    WHERE len(string_split(l.path, '/')) - 1 < 3 AND l.is_symlink AND t.path IS NULL)"""

oracle("diagnostics", _CORPUS, _LINKED, _CODES, "SELECT path, code, message FROM found")
oracle(
    "diagnostic_counts",
    _CORPUS,
    _LINKED,
    _CODES,
    'SELECT code, count(*) AS "count" FROM found GROUP BY code',
)
oracle(
    "content_plugin_lines",
    _CORPUS,
    _KEPT,
    _chunked("kept"),
    """lines AS (SELECT path, k, chunk, 1 + coalesce(sum(len(regexp_extract_all(hex(chunk),
         '(?:(?:[1-9A-F].|0[0-9B-F])*)(0A)'))) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
         AND 1 PRECEDING), 0) AS line FROM chunks)""",
    """numbered AS (SELECT path, unhex(string_agg(hex(encode(line || ': ') || chunk), '' ORDER BY k)) AS body
         FROM lines GROUP BY path)""",
    """SELECT path, 'ok' AS status, size AS input_bytes, md5(coalesce(body, ''::BLOB)) AS md5,
         octet_length(coalesce(body, ''::BLOB)) AS bytes FROM kept LEFT JOIN numbered USING (path)""",
)


_RELATIVE = f"""raw AS (SELECT parent, name, CASE name WHEN 'self' THEN './self' WHEN 'lost' THEN '../' || climb || target
    WHEN 'first' THEN './/x/.././' || climb || target || '/.' WHEN 'twin' THEN '/data/tree/./' || target || '/'
    WHEN 'up' THEN '/data/other/' || target ELSE climb || target END AS raw
  FROM (SELECT *, repeat('../', 1 + length(parent) - length(replace(parent, '/', ''))) AS climb FROM direct)),
links AS (SELECT parent, name, CASE WHEN starts_with(raw, '/') THEN CASE WHEN starts_with(n, '/data/tree/') THEN substr(n, 12) END
    WHEN NOT starts_with(n, '!') THEN substr(n, 2) END AS target, raw
  FROM (SELECT *, {_normalized("CASE WHEN starts_with(raw, '/') THEN raw ELSE parent || '/' || raw END")} AS n FROM raw)),
plain AS ("""
_RELATIVE_TREE = _TREE.replace("links AS (", "direct AS (", 1).replace("plain AS (", _RELATIVE, 1).replace("encode(l.target)", "encode(l.raw)").replace("strlen(l.target)", "strlen(l.raw)")
oracle(
    "symlink_relative",
    _RELATIVE_TREE,
    "SELECT path, physical AS physical_path, is_directory, is_symlink, size, is_cycle FROM walk",
    recursive=True,
)
