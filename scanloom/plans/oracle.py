"""The same results in SQL, for a check against another engine on the same tables.

The SQL is put together from the same rule packs, but goes its own way: lines are unnested, every rule is a CASE of
its own, match positions come from running sums over gaps, and thinning out is a recursive query.
"""

from __future__ import annotations

from collections.abc import Sequence

from scanloom import fixed_values as fv
from scanloom.operators.dependencies import KNOWN_TEXT, UNPINNED_TEXT, load_advisories
from scanloom.plans import queries as q
from scanloom.rules import Rule, builtin_rules, language_rules, secret_rules
from scanloom.sources import derived as d


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def pick(values, index: str) -> str:
    return f"([{lits(values)}])[({index}) + 1]"


def re2(pattern: str) -> str:
    """The pattern without look-aheads, which the other engine lacks; none of them decides anything on these tables."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("(?!", i):
            depth, i = 1, i + 3
            while depth:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "(":
                    depth += 1
                elif pattern[i] == ")":
                    depth -= 1
                i += 1
        else:
            step = 2 if pattern[i] == "\\" else 1
            out += pattern[i:i + step]
            i += step
    return out


# ---- inputs ---------------------------------------------------------------------------------------------

DIRS = [x for x in d.CORPUS_DIRS]
KINDS = len(d.CORPUS_FILES)
INNER = (f"{pick(DIRS, f'doc_id % {len(DIRS)}')} || '/d' || doc_id || '/' || "
         f"{pick([n for n, _, _ in d.CORPUS_FILES], f'doc_id % {KINDS}')}")
CORPUS = f"""corpus AS (
  SELECT doc_id AS fid, doc_id, repo, repo || '/' || inner_path AS path, inner_path,
    text || CASE WHEN v IN (1, 3) THEN chr(10) || {pick([a for _, a, _ in d.CORPUS_FILES], f'doc_id % {KINDS}')} ELSE '' END
         || CASE WHEN v IN (2, 3) THEN chr(10) || {pick([b for _, _, b in d.CORPUS_FILES], f'doc_id % {KINDS}')} ELSE '' END
      AS content
  FROM (SELECT doc_id, text, 'repo' || (doc_id % 10) AS repo, {INNER} AS inner_path, (doc_id // {KINDS}) % 4 AS v
        FROM documents))"""


def language_case(path: str, content: str) -> str:
    base = f"lower(regexp_extract({path}, '[^/]*$'))"
    ext = f"lower(regexp_extract(regexp_extract({path}, '[^/]*$'), '[^.].*(\\.[^.]*)$', 1))"
    by_language: dict[str, list[str]] = {}
    for e, language in fv.EXTENSION_LANGUAGE.items():
        by_language.setdefault(language, []).append(e)
    whens = [f"WHEN {base} IN ({lits(fv.DOCKERFILE_NAMES)}) THEN 'dockerfile'"]
    whens += [f"WHEN {ext} IN ({lits(es)}) THEN {lit(language)}" for language, es in by_language.items()]
    for regex, flags, language in fv.CONTENT_LANGUAGE:
        inline = f"(?{flags.replace('u', '')})" if flags else ""
        whens.append(f"WHEN regexp_matches({content}, {lit(inline + regex)}) THEN {lit(language)}")
    return "CASE " + " ".join(whens) + " ELSE 'unknown' END"


def selection(path: str) -> tuple[str, str]:
    dirs = f"string_split(lower({path}), '/')"
    listed = f"NOT list_has_any(list_slice({dirs}, 1, len({dirs}) - 1), [{lits(fv.SKIP_DIRS)}])"
    ext = f"lower(regexp_extract(regexp_extract({path}, '[^/]*$'), '[^.].*(\\.[^.]*)$', 1))"
    wanted = (f"({ext} IN ({lits(fv.EXTENSION_LANGUAGE)}) OR "
              f"lower(regexp_extract({path}, '[^/]*$')) IN ({lits(fv.DOCKERFILE_NAMES)}))")
    return listed, f"({listed}) AND {wanted}"


LISTED, IN_SCAN = selection("inner_path")
FILES = f"""{CORPUS},
files AS MATERIALIZED (
  SELECT *, {LISTED} AS listed, {IN_SCAN} AS in_scan, {language_case('path', 'content')} AS language FROM corpus)"""
SELECTED = f"{FILES},\nsrc AS (SELECT * FROM files WHERE in_scan)"

_filler = "repeat('x = 1' || chr(10), CAST(doc_id % {n} AS INTEGER))"
_block = pick([b for _, b in d.MULTILINE_BLOCKS], "doc_id % 4")
MULTILINE = f"""raw_ml AS (
  SELECT doc_id AS fid, 'ml/d' || doc_id || {pick([s for s, _ in d.MULTILINE_BLOCKS], 'doc_id % 4')} AS path,
    text || chr(10) || {_block}
      || repeat(chr(10) || {_filler.format(n=5)} || {_block}, CAST(doc_id % 3 AS INTEGER)) AS content
  FROM documents),
src AS MATERIALIZED (SELECT *, {language_case('path', 'content')} AS language FROM raw_ml)"""

HEREDOC = f"""src AS MATERIALIZED (
  SELECT doc_id AS fid, 'h/d' || doc_id || '.php' AS path, 'php' AS language,
    text || chr(10) || {lit(d.ONE_LINE_HEREDOC)} || chr(10) || {_filler.format(n=7)}
      || CASE WHEN doc_id % 2 = 1 THEN {lit(d.ONE_LINE_HEREDOC)} || chr(10) ELSE '' END
      || {_filler.format(n=7)} || {lit(d.HEREDOC)} AS content
  FROM documents)"""

CATALOGUE = f"""raw_cat AS (
  SELECT doc_id AS fid, 'cat/d' || doc_id || '/' || {pick([n for n, _ in d.CATALOGUE_FILES], f'doc_id % {len(d.CATALOGUE_FILES)}')} AS path,
    concat_ws(chr(10), text, {pick([chr(10).join(x) for _, x in d.CATALOGUE_FILES], f'doc_id % {len(d.CATALOGUE_FILES)}')},
      {pick(d.SECRET_LINES, f'doc_id % {len(d.SECRET_LINES)}')}) AS content
  FROM documents),
src AS MATERIALIZED (SELECT *, {language_case('path', 'content')} AS language FROM raw_cat)"""

_names: dict[str, str] = {}
for _language, _keys in fv.LANGUAGE_KEYS.items():
    for _key in [*_keys, _language]:
        _names.setdefault(_key, _language)
_alias = " ".join(f"WHEN lower(declared_language) = {lit(k)} THEN {lit(v)}" for k, v in _names.items())
TEXTS = f"""texts AS (
  SELECT conv_id || '-' || turn AS id, {pick([x for x, _ in d.DECLARED], f'turn % {len(d.DECLARED)}')} AS declared_language,
    text || chr(10) || {pick([x for _, x in d.DECLARED], f'turn % {len(d.DECLARED)}')} AS content
  FROM conversations),
src AS MATERIALIZED (
  SELECT id AS fid, id, 'input' AS path, declared_language, content,
    CASE {_alias} ELSE {language_case("'file.' || declared_language", 'content')} END AS language
  FROM texts)"""

PAGES = f"""raw_pages AS (
  SELECT page_id AS fid, page_id, 'input' AS path,
    html || chr(10) || {pick(d.PAGE_LINES, f'page_id % {len(d.PAGE_LINES)}')} AS content FROM pages),
src AS MATERIALIZED (SELECT *, {language_case('path', 'content')} AS language FROM raw_pages)"""


# ---- matching -------------------------------------------------------------------------------------------

def languages_of(rule: Rule) -> list[str]:
    return [x for x in fv.LANGUAGE_KEYS if language_rules([rule], x)]


def single_sql(rules: Sequence[Rule], lines: str, any_language: bool = False) -> str:
    parts = []
    for r in rules:
        if not r.single:
            continue
        flag = "(?i)" if r.ignore_case else ""
        whens = " ".join(f"WHEN regexp_matches(line, {lit(flag + re2(p.text))}) THEN {p.idx}" for p in r.single)
        where = "" if any_language else f" WHERE language IN ({lits(languages_of(r))})"
        parts.append(f"SELECT fid, {r.ord} AS rule_ord, CASE {whens} END AS pattern_idx, line_number FROM {lines}{where}")
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE pattern_idx IS NOT NULL"


def rules_values(rules: Sequence[Rule]) -> str:
    rows = ", ".join(f"({r.ord}, {lits([r.id, r.name, r.category, r.severity, r.description, r.remediation])})"
                     for r in rules)
    return (f"(VALUES {rows}) AS r(rule_ord, rule_id, rule_name, category, severity, description, remediation)")


def patterns_values(rules: Sequence[Rule], kind: str) -> str:
    rows = ", ".join(f"({r.ord}, {p.idx}, {lit(p.text)})" for r in rules for p in getattr(r, kind))
    return f"(VALUES {rows}) AS p(rule_ord, pattern_idx, matched_pattern)"


def lines_cte(name: str, src: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT fid, language, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_number
  FROM (SELECT fid, language, string_split(content, chr(10)) AS ls FROM {src}))"""


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def multi_ctes(rules: Sequence[Rule]) -> str:
    parts = []
    for r in rules:
        for p in r.multi:
            regex = lit(rf"(?is)([\s\S]*?)(?:{re2(p.text)})")
            parts.append(
                f"SELECT fid, {r.ord} AS rule_ord, {p.idx} AS pattern_idx, "
                f"regexp_extract_all(content, {regex}, 0) AS whole, regexp_extract_all(content, {regex}, 1) AS gap "
                f"FROM src WHERE language IN ({lits(languages_of(r))}) AND regexp_matches(content, {lit('(?is)' + re2(p.text))})")
    ids = ", ".join(f"({r.ord}, {lit(r.id)})" for r in rules)
    return f"""
spans AS (
  SELECT fid, rule_ord, pattern_idx, unnest(whole) AS whole, unnest(gap) AS gap, generate_subscripts(whole, 1) AS k
  FROM ({chr(10).join(('' if i == 0 else 'UNION ALL ') + x for i, x in enumerate(parts))})),
placed AS (
  SELECT fid, rule_ord, pattern_idx, k,
    1 + coalesce(sum({newlines('whole')}) OVER before, 0) + {newlines('gap')} AS line_number,
    1 + coalesce(sum({newlines('whole')}) OVER before, 0) + {newlines('whole')} AS line_end,
    substr(whole, length(gap) + 1) AS matched
  FROM spans WINDOW before AS (PARTITION BY fid, rule_ord, pattern_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
candidates AS MATERIALIZED (
  SELECT c.*, i.rule_id, row_number() OVER (PARTITION BY fid, i.rule_id ORDER BY line_number, c.rule_ord, pattern_idx, k) AS rn
  FROM placed c JOIN (VALUES {ids}) AS i(rule_ord, rule_id) ON c.rule_ord = i.rule_ord
  WHERE NOT regexp_full_match(matched, '\\s*')),
walk AS (
  SELECT fid, rule_id, rn, rule_ord, pattern_idx, line_number, line_end, true AS kept, line_end AS last_end
  FROM candidates WHERE rn = 1
  UNION ALL
  SELECT c.fid, c.rule_id, c.rn, c.rule_ord, c.pattern_idx, c.line_number, c.line_end, c.line_number - w.last_end > 3,
    CASE WHEN c.line_number - w.last_end > 3 THEN c.line_end ELSE w.last_end END
  FROM walk w JOIN candidates c ON c.fid = w.fid AND c.rule_id = w.rule_id AND c.rn = w.rn + 1),
last_single AS (
  SELECT fid, rule_id, matched_pattern, max(line_number) AS last_line
  FROM single JOIN {patterns_values(rules, 'single')} USING (rule_ord, pattern_idx)
  JOIN (VALUES {ids}) AS i(rule_ord, rule_id) USING (rule_ord) GROUP BY ALL),
multi AS (
  SELECT w.fid, w.rule_ord, w.pattern_idx, CAST(w.line_number AS INTEGER) AS line_number, CAST(w.line_end AS INTEGER) AS line_end
  FROM walk w JOIN {patterns_values(rules, 'multi')} USING (rule_ord, pattern_idx)
  WHERE kept AND NOT EXISTS (
    SELECT 1 FROM last_single s WHERE s.fid = w.fid AND s.rule_id = w.rule_id
      AND s.matched_pattern = p.matched_pattern AND s.last_line = w.line_number))"""


def findings(source: str, multi_line: bool = True, secrets_from: str | None = None, language_rules_too: bool = True) -> str:
    """WITH clause ending in ``findings``: the columns of ``src`` (but for content) and those of a finding."""
    rules, secrets = builtin_rules(), secret_rules()
    ctes = [f"WITH RECURSIVE {source}"]
    unions = []
    if language_rules_too:
        ctes.append(lines_cte("ln", "src"))
        ctes.append(f"single AS MATERIALIZED ({single_sql(rules, 'ln')})")
        unions.append(f"""SELECT s.fid, 0 AS pass_ord, s.rule_ord, pattern_idx, line_number, CAST(NULL AS INTEGER) AS line_end,
    line_number - 2 AS first, line_number + 2 AS last, 'single-line' AS match_type, matched_pattern, r.* EXCLUDE (rule_ord)
  FROM single s JOIN {rules_values(rules)} USING (rule_ord)
  JOIN {patterns_values(rules, 'single')} USING (rule_ord, pattern_idx)""")
        if multi_line:
            ctes.append(multi_ctes(rules).strip())
            unions.append(f"""SELECT s.fid, 1, s.rule_ord, pattern_idx, line_number, line_end, line_number - 1, line_end + 1,
    'multi-line', matched_pattern, r.* EXCLUDE (rule_ord)
  FROM multi s JOIN {rules_values(rules)} USING (rule_ord)
  JOIN {patterns_values(rules, 'multi')} USING (rule_ord, pattern_idx)""")
    if secrets_from:
        ctes.append(lines_cte("all_ln", secrets_from))
        ctes.append(f"secret AS MATERIALIZED ({single_sql(secrets, 'all_ln', True)})")
        unions.append(f"""SELECT s.fid, 2 AS pass_ord, s.rule_ord, pattern_idx, line_number, CAST(NULL AS INTEGER) AS line_end,
    line_number - 2 AS first, line_number + 2 AS last, 'secret' AS match_type, '' AS matched_pattern, r.* EXCLUDE (rule_ord)
  FROM secret s JOIN {rules_values(secrets)} USING (rule_ord)""")
    ctes.append("hits AS (" + "\n  UNION ALL ".join(unions) + ")")
    ctes.append(f"""findings AS (
  SELECT f.* EXCLUDE (content, path), f.path AS file_path, h.* EXCLUDE (fid, first, last),
    array_to_string(list_slice(string_split(f.content, chr(10)), greatest(first, 1), last), chr(10)) AS code_snippet,
    '' AS cwe, '' AS owasp
  FROM hits h JOIN {secrets_from or 'src'} f USING (fid))""")
    return ",\n".join(ctes) + "\n"


ON_CORPUS = findings(SELECTED)
SHORT = ", ".join(q.SHORT)
SECRETS = findings(FILES, secrets_from="files", language_rules_too=False)
WIRE = ("rule_id, rule_name, category, severity, file_path, line_number, line_end, code_snippet, description, "
        "remediation, match_type, cwe, owasp")


# ---- manifests ------------------------------------------------------------------------------------------

ADVISORIES = ", ".join(
    f"({lits([a['ecosystem'], a['package'], a['severity'], a['reason'], a.get('safe_version')])})" for a in load_advisories())
MANIFESTS = f"""advisory AS (
  SELECT * FROM (VALUES {ADVISORIES}) AS a(ecosystem, name, severity, reason, safe_version)),
mline AS (
  SELECT p_partkey // 20 AS manifest_id, p_partkey % 20 AS slot, p_size,
    row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS n
  FROM part),
manifest AS (
  SELECT DISTINCT manifest_id, 'repo' || (manifest_id % 10) AS repo,
    'm' || manifest_id || '/' || {pick(d.MANIFEST_NAMES, 'manifest_id % 4')} AS path FROM mline),
npm AS (
  SELECT manifest_id, 1 AS line_number, {pick(d.NPM_NAMES, 'slot')} AS package, {pick(d.NPM_VERSIONS, 'p_size % 8')} AS version
  FROM mline WHERE manifest_id % 4 = 0),
req AS (
  SELECT manifest_id, n + 2 AS line_number, trim({pick(d.PYPI_NAMES, 'slot')} || {pick(d.PYPI_SUFFIXES, 'p_size % 6')}) AS line
  FROM mline WHERE manifest_id % 4 = 1),
pypi AS (
  SELECT manifest_id, line_number, regexp_extract(line, '^([A-Za-z0-9_.-]+)', 1) AS package,
    regexp_extract(line, '^[A-Za-z0-9_.-]+\\s*([><=!~]{{0,2}})', 1) AS operator,
    regexp_extract(line, '^[A-Za-z0-9_.-]+\\s*[><=!~]{{0,2}}\\s*([A-Za-z0-9._*-]*)', 1) AS version FROM req),
go AS (
  SELECT manifest_id, n AS line_number, name AS package
  FROM (SELECT *, trim({pick(d.GO_LINES, f'p_size % {len(d.GO_LINES)}')}, ' ' || chr(9)) AS line FROM mline WHERE manifest_id % 4 = 2)
  JOIN advisory ON ecosystem = 'go' AND contains(line, name)
  WHERE NOT starts_with(line, '//') AND (starts_with(line, 'require') OR contains(line, chr(9)))),
cargo AS (
  SELECT manifest_id, n AS line_number, name AS package
  FROM (SELECT *, trim({pick(d.CARGO_LINES, f'p_size % {len(d.CARGO_LINES)}')}) AS line FROM mline WHERE manifest_id % 4 = 3)
  JOIN advisory ON ecosystem = 'cargo' AND starts_with(line, name)),
packages AS (
  SELECT *, path AS file_path FROM (
    SELECT manifest_id, 'npm' AS ecosystem, lower(package) AS name, package, NULL AS operator, version, line_number FROM npm
    UNION ALL SELECT manifest_id, 'pypi', replace(lower(package), '-', '_'), package, operator, version, line_number FROM pypi
    UNION ALL SELECT manifest_id, 'go', package, package, NULL, NULL, line_number FROM go
    UNION ALL SELECT manifest_id, 'cargo', package, package, NULL, NULL, line_number FROM cargo)
  JOIN manifest USING (manifest_id)),
unpinned AS (
  SELECT * FROM packages WHERE
    (ecosystem = 'npm' AND (version IN ('*', 'latest', 'next', 'canary', '', 'x') OR version[1] IN ('^', '~')))
    OR (ecosystem = 'pypi' AND (operator = '' OR version = '')))"""


def text_case(texts: dict, which: int) -> str:
    whens = []
    for eco, pair in texts.items():
        pieces = pair[which].replace("}", "{").split("{")
        whens.append(f"WHEN ecosystem = '{eco}' THEN " + " || ".join(
            f"coalesce({x}, '')" if i % 2 else lit(x) for i, x in enumerate(pieces)))
    return "CASE " + " ".join(whens) + " END"


PREFIX = "CASE ecosystem " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.ECOSYSTEM_RULE_PREFIX.items()) + " END"
CLEAN = "CASE WHEN version <> '' THEN regexp_replace(trim(version), '^[\\^~>=<!]+', '') END"
ISSUES = f"""{MANIFESTS},
issues AS (
  SELECT manifest_id, repo, path, file_path, ecosystem, package, line_number, 'unpinned' AS issue_type,
    {PREFIX} || 'UNPIN' AS rule_id, 'Low' AS severity, CASE WHEN ecosystem = 'npm' THEN version END AS current_version,
    {text_case(UNPINNED_TEXT, 0)} AS description, {text_case(UNPINNED_TEXT, 1)} AS remediation
  FROM unpinned
  UNION ALL
  SELECT manifest_id, repo, path, file_path, ecosystem, package, line_number, 'known_vulnerable',
    {PREFIX} || left(upper(CASE WHEN ecosystem = 'go' THEN string_split(name, '/')[-1] ELSE name END), 8), severity,
    CASE WHEN ecosystem = 'npm' THEN {CLEAN} WHEN version <> '' THEN version END,
    {text_case(KNOWN_TEXT, 0)}, {text_case(KNOWN_TEXT, 1)}
  FROM packages JOIN advisory USING (ecosystem, name)),
dep_findings AS (
  SELECT *, 'Dependency: ' || package || CASE issue_type WHEN 'unpinned' THEN ' (Unpinned)' ELSE ' (Known Vulnerable)' END AS rule_name,
    'Dependency Analysis' AS category, CAST(NULL AS INTEGER) AS line_end,
    'Package: ' || package || '  Version: ' || coalesce(nullif(current_version, ''), 'unspecified') AS code_snippet,
    'dependency' AS match_type, {lit(fv.DEPENDENCY_CWE)} AS cwe, {lit(fv.DEPENDENCY_OWASP)} AS owasp
  FROM issues)"""

_code = findings(f"{SELECTED},\n{ISSUES}", secrets_from="files")
EVERYTHING = _code + """, everything AS (
  SELECT repo, language, pass_ord, rule_ord, pattern_idx, rule_id, rule_name, category, severity, file_path, line_number,
    line_end, code_snippet, match_type, matched_pattern FROM findings
  UNION ALL
  SELECT repo, NULL, 3, 0, 0, rule_id, rule_name, category, severity, file_path, CAST(line_number AS INTEGER), line_end,
    code_snippet, match_type, '' FROM dep_findings)
"""

WEIGHT = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in fv.SEVERITY_WEIGHT.items()) + " ELSE 0 END"
RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {o}" for s, o in fv.SEVERITY_ORDER.items()) + " ELSE 99 END"


def score(penalty: str) -> str:
    return f"CAST(greatest(0, 100 - least(coalesce({penalty}, 0), 100)) AS DOUBLE)"


def grade(value: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {f} THEN '{g}'" for f, g in fv.GRADE_FLOORS) + f" ELSE '{fv.LOWEST_GRADE}' END"


def n_of(column: str, value: str) -> str:
    return f"count(*) FILTER (WHERE {column} = {lit(value)})"


def per_repo(columns: str, by: str = "repo") -> str:
    """Aggregates over findings per group, groups without findings included."""
    keys = {"repo": "repo", "repo, file_path": "repo, path AS file_path"}[by]
    return (f"SELECT {by}, {columns} FROM (SELECT DISTINCT {keys} FROM src) LEFT JOIN findings "
            f"USING ({by}) GROUP BY {by}")


# ---- history --------------------------------------------------------------------------------------------

_penalty = "10 * critical + 5 * high + 2 * medium + low"
HISTORY = f"""WITH counted AS (
  SELECT user_id, CAST(ts AS DATE) AS day, {n_of('event_type', 'error')} AS critical, {n_of('event_type', 'signup')} AS high,
    {n_of('event_type', 'purchase')} AS medium, {n_of('event_type', 'view')} AS low, max(ts) AS ts
  FROM events GROUP BY ALL),
history AS (
  SELECT user_id || '-' || strftime(day, '%Y%m%d') AS id, {pick(d.SCAN_TYPES, 'user_id % 4')} AS scan_type,
    'user' || user_id AS source, ts, critical + high + medium + low AS total, critical, high, medium, low,
    {score(_penalty)} AS score, {grade(score(_penalty))} AS grade FROM counted)
"""
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"

# ---- rules ----------------------------------------------------------------------------------------------

CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(
    f"({r.ord}, {lits([r.id, r.name, r.category, r.severity])}, [{lits(r.languages)}], {len(r.patterns)}, "
    f"{len(r.multi_line_patterns)})" for r in builtin_rules()
) + ") AS c(rule_ord, id, name, category, severity, languages, patterns, multi_line_patterns))"

_k = "p_partkey"
_severities = [(s or "medium").capitalize() if (s or "medium").lower() in ("low", "medium", "high", "critical") else "Medium"
               for s in d.CUSTOM_SEVERITIES]
CUSTOM = f"""custom AS (
  SELECT {_k} AS position,
    CASE WHEN {_k} % 10 = 0 THEN 'CUSTOM-000' WHEN {_k} % 10 = 1 THEN {pick(d.CUSTOM_RULE_IDS, f'{_k} % 3')}
      ELSE 'PART-' || ({_k} % 500) END AS id,
    CASE WHEN {_k} % 4 <> 0 THEN p_name ELSE 'Custom Rule' END AS name,
    CASE WHEN {_k} % 3 = 0 THEN 'PARTS' ELSE 'Custom' END AS category,
    {pick(_severities, f'{_k} % {len(_severities)}')} AS severity,
    {pick([','.join(x or []) for x in d.CUSTOM_LANGUAGES], f'{_k} % {len(d.CUSTOM_LANGUAGES)}')} AS languages,
    p_brand AS patterns, CASE WHEN {_k} % 7 = 0 THEN p_type ELSE '' END AS multi_line_patterns
  FROM part)"""
MERGED = f"""WITH {CATALOG}, {CUSTOM},
last_custom AS (SELECT id, max_by(custom, position) AS c FROM custom GROUP BY id),
merged AS (
  SELECT rule_ord, 0 AS block, CAST(0 AS BIGINT) AS position, b.id, coalesce(c.name, b.name) AS name,
    coalesce(c.category, b.category) AS category, coalesce(c.severity, b.severity) AS severity,
    CASE WHEN c IS NULL THEN array_to_string(b.languages, ',') ELSE c.languages END AS languages,
    CASE WHEN c IS NULL THEN b.multi_line_patterns > 0 ELSE c.multi_line_patterns <> '' END AS has_multi_line_patterns
  FROM catalog b LEFT JOIN last_custom l ON b.id = l.id
  UNION ALL
  SELECT NULL, 1, position, id, name, category, severity, languages, multi_line_patterns <> ''
  FROM custom WHERE id NOT IN (SELECT id FROM catalog))
"""

KEYS = "keys AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lit(language)}, {lit(k)})" for language, names in fv.LANGUAGE_KEYS.items() for k in names) + ") AS k(language, key))"
RULE_LANGUAGES = f"""{CATALOG}, {KEYS},
rule_language AS (
  SELECT DISTINCT language, id AS rule_id FROM (SELECT id, unnest(languages) AS key FROM catalog) JOIN keys USING (key))"""

FIRST = fv.FIRST_FINDINGS
def numbered(first: str) -> str:
    return EVERYTHING + f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {first}file_path COLLATE C, pass_ord,
      CASE WHEN pass_ord = 1 THEN rule_id END NULLS FIRST, line_number, rule_ord, pattern_idx, rule_id, rule_name) AS finding_number,
    count(*) OVER (PARTITION BY repo) AS findings_in_group
  FROM everything)
"""


#: A repository's report has the language rules' findings of all files first.
NUMBERED = numbered("CASE WHEN pass_ord > 1 THEN 1 ELSE 0 END, ")
ADVISED = f"WITH {MANIFESTS} SELECT path, CAST(line_number AS INTEGER) AS line_number, package"

ORACLE = {
    "scan_corpus_files": ON_CORPUS + f"SELECT {SHORT}, matched_pattern FROM findings",
    "scan_text_rows": findings(TEXTS) + f"SELECT id, language, {SHORT} FROM findings",
    "scan_pages": findings(PAGES) + f"SELECT page_id, language, {SHORT} FROM findings",
    "expand_archives": f"""WITH {CORPUS}
SELECT 'a' || doc_id AS archive, inner_path, md5(content) AS content_md5, false AS failed FROM corpus
UNION ALL SELECT 'a' || doc_id, 'NOTE', md5('packed' || chr(10)), false FROM corpus
UNION ALL SELECT 'b' || doc_id, NULL, NULL, true FROM corpus WHERE doc_id % 50 = 7""",
    "scan_archives": ON_CORPUS + f"""SELECT 'a' || doc_id AS archive, rule_id, severity, inner_path AS file_path, line_number,
  line_end, match_type FROM findings""",
    "scan_by_repo": ON_CORPUS + "SELECT repo, inner_path AS file_path, count(*) AS findings FROM findings GROUP BY ALL",
    "files_scanned_by_repo": f"WITH {FILES} SELECT repo, count(*) FILTER (WHERE listed) AS files_scanned FROM files GROUP BY repo",
    "rule_catalog": findings(f"{SELECTED}, {CATALOG}") + """
SELECT c.rule_ord, id, name, c.category, c.severity, array_to_string(languages, ',') AS languages, patterns,
  multi_line_patterns, coalesce(n, 0) AS findings
FROM catalog c LEFT JOIN (SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id) ON rule_id = id""",
    "custom_rules_load": f"""WITH {CUSTOM} SELECT position, id, name, category, severity, '' AS description,
  '' AS remediation, languages, patterns, multi_line_patterns FROM custom""",
    "merge_rules": MERGED + "SELECT rule_ord, block, position, id, name, category, severity, languages FROM merged",
    "advisory_by_severity": f"""WITH {MANIFESTS} SELECT ecosystem, severity, count(*) AS uses, count(DISTINCT name) AS packages
FROM packages JOIN advisory USING (ecosystem, name) GROUP BY ALL""",
    "manifest_files": f"""WITH {CORPUS}, {MANIFESTS} SELECT path FROM (SELECT path FROM corpus UNION ALL SELECT path FROM manifest)
WHERE lower(regexp_extract(path, '[^/]*$')) IN ({lits(fv.MANIFEST_FILES)})""",
    "findings_from_json": ON_CORPUS + f"""SELECT rule_id, severity, file_path, line_number, line_end,
  CASE WHEN line_number % 2 = 0 THEN match_type ELSE 'single-line' END AS match_type, rule_name, category, code_snippet,
  cwe, owasp, '' AS matched_pattern FROM findings""",
    "report_json": ON_CORPUS + per_repo(f"""{lit(q.GENERATED_AT)} AS generated_at, count(rule_id) AS total_vulnerabilities,
  {score(f'sum({WEIGHT})')} AS security_score, {grade(score(f'sum({WEIGHT})'))} AS security_grade,
  {n_of('severity', 'Critical')} AS critical, {n_of('category', 'A03')} AS a03, {n_of('match_type', 'single-line')} AS single_line,
  count(rule_id) AS rows"""),
    "report_csv_rows": ON_CORPUS + """SELECT rule_id, rule_name, category, severity, file_path, line_number, line_end,
  description, remediation, match_type, cwe, owasp FROM findings""",
    "history_read": HISTORY + f"SELECT id, scan_type, source, {TS}, total, critical, high, medium, low, score, grade FROM history",
    "history_top50": HISTORY + f"""SELECT id, source, {TS}, total, score, grade
FROM (SELECT * FROM history ORDER BY ts DESC, id DESC LIMIT {fv.HISTORY_KEEP})""",
    "detect_language": f"""WITH {FILES}, {PAGES} SELECT path, language FROM files
UNION ALL SELECT 'page' || page_id, language FROM src""",
    "resolve_language_alias": f"WITH {TEXTS} SELECT id, declared_language, language FROM src",
    "applicable_rules": f"""WITH {SELECTED}, {RULE_LANGUAGES}
SELECT language, rule_id, files FROM rule_language JOIN (SELECT language, count(*) AS files FROM src GROUP BY ALL) USING (language)""",
    "files_x_rules": f"WITH {SELECTED}, {RULE_LANGUAGES} SELECT path, language, rule_id FROM src JOIN rule_language USING (language)",
    "rules_by_language": f"""WITH {TEXTS}, {CATALOG}
SELECT declared_language, texts, id AS rule_id FROM (SELECT declared_language, count(*) AS texts FROM src GROUP BY ALL)
JOIN catalog ON list_contains(languages, lower(declared_language))""",
    "rules_by_category": findings(f"{SELECTED}, {CATALOG}") + """SELECT id AS rule_id, name, coalesce(n, 0) AS findings
FROM catalog c LEFT JOIN (SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id) ON rule_id = id WHERE c.category = 'A03'""",
    "explode_lines": f"WITH {CORPUS}, corpus_l AS (SELECT *, '' AS language FROM corpus), {lines_cte('ln', 'corpus_l')}\n"
                     "SELECT path, line_number, line FROM ln JOIN corpus USING (fid)",
    "single_line_findings": findings(SELECTED, multi_line=False)
                            + "SELECT file_path, rule_id, line_number, pattern_idx, matched_pattern FROM findings",
    "multi_line_findings": findings(MULTILINE) + """SELECT file_path, rule_id, line_number, line_end, pattern_idx, code_snippet
FROM findings WHERE match_type = 'multi-line'""",
    "finding_snippets": ON_CORPUS + "SELECT file_path, rule_id, line_number, match_type, code_snippet FROM findings",
    "single_line_only": findings(HEREDOC, multi_line=False) + f"SELECT {SHORT} FROM findings",
    "findings_wire": ON_CORPUS + f"SELECT {WIRE} FROM findings",
    "filter_findings": ON_CORPUS + f"SELECT {SHORT} FROM findings WHERE severity = 'High' AND category = 'A05'",
    "search_findings": ON_CORPUS + f"""SELECT {SHORT} FROM findings WHERE contains(lower(rule_name), {lit(q.SEARCH_TEXT.lower())})
  OR contains(lower(file_path), {lit(q.SEARCH_TEXT.lower())}) OR contains(lower(description), {lit(q.SEARCH_TEXT.lower())})""",
    "search_history": HISTORY + f"""SELECT id, source, scan_type FROM history
WHERE contains(lower(source), {lit(q.HISTORY_SEARCH.lower())}) OR contains(lower(scan_type), {lit(q.HISTORY_SEARCH.lower())})""",
    "scan_risk_status": HISTORY + "SELECT id, " + ", ".join(
        f"CASE WHEN critical > 0 THEN 'Critical' WHEN high > 0 THEN 'High' WHEN total > 0 THEN 'Medium' ELSE '{clean}' END AS {name}"
        for name, clean in (("project_status", "Clean"), ("report_risk", "Low"))
    ) + ", CASE scan_type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.SCAN_TYPE_LABELS.items())
        + " ELSE scan_type END AS scan_type_label FROM history",
    "scan_age_bucket": HISTORY + f""", aged AS (
  SELECT id, (epoch_us(TIMESTAMP '{q.AS_OF}') - epoch_us(ts)) // 60000000 AS m FROM history)
SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago'
  ELSE (m // 1440) || 'd ago' END AS age FROM aged""".replace(")\n, aged", "), aged"),
    "quality_gate": ON_CORPUS + per_repo(f"""count(*) FILTER (WHERE {RANK} <= 1) AS reported,
  coalesce(bool_or(severity IN ('Critical', 'High')), false) AS failed"""),
    "npm_advisories": ADVISED + ", version, severity FROM packages JOIN advisory USING (ecosystem, name) WHERE ecosystem = 'npm'",
    "pypi_advisories": ADVISED + ", version, severity FROM packages JOIN advisory USING (ecosystem, name) WHERE ecosystem = 'pypi'",
    "go_advisories": ADVISED + ", severity FROM packages JOIN advisory USING (ecosystem, name) WHERE ecosystem = 'go'",
    "cargo_advisories": ADVISED + ", severity FROM packages JOIN advisory USING (ecosystem, name) WHERE ecosystem = 'cargo'",
    "suppress_covered": findings(HEREDOC) + f"SELECT {SHORT} FROM findings",
    "finding_totals": ON_CORPUS + per_repo("count(rule_id) AS total"),
    "by_severity": ON_CORPUS + f""", sev AS (SELECT unnest([{lits(fv.SEVERITY_ORDER)}]) AS severity),
repos AS (SELECT DISTINCT repo FROM src)
SELECT r.repo, s.severity, count(f.rule_id) AS findings FROM repos r CROSS JOIN sev s
LEFT JOIN findings f ON f.repo = r.repo AND f.severity = s.severity GROUP BY ALL""",
    "by_category": ON_CORPUS + "SELECT category, count(*) AS findings FROM findings GROUP BY category",
    "by_file": ON_CORPUS + "SELECT file_path, count(*) AS findings FROM findings GROUP BY file_path",
    "by_match_type": EVERYTHING + f""", types AS (SELECT unnest([{lits(fv.MATCH_TYPES)}]) AS match_type)
SELECT t.match_type, count(e.rule_id) AS findings FROM types t LEFT JOIN everything e USING (match_type) GROUP BY ALL""",
    "security_score": ON_CORPUS + per_repo(f"count(rule_id) AS total, {score(f'sum({WEIGHT})')} AS score", "repo, file_path"),
    "security_grade": ON_CORPUS + ", scored AS (" + per_repo(
        f"count(rule_id) AS total, {score(f'sum({WEIGHT})')} AS score", "repo, file_path") + f""")
SELECT *, {grade('score')} AS grade, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM scored""",
    "repo_security": ON_CORPUS + ", scored AS (" + per_repo(
        f"count(rule_id) AS total, {score(f'sum({WEIGHT})')} AS score") + f""")
SELECT *, {grade('score')} AS grade, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM scored""",
    "history_kpis": HISTORY + f""", k AS (
  SELECT count(*) AS scans, CAST(coalesce(floor(avg(score) + 0.5), 100) AS BIGINT) AS average_score,
    CAST(sum(total) AS BIGINT) AS total_found, CAST(sum(critical) AS BIGINT) AS critical_found,
    CAST(sum(high) AS BIGINT) AS high_found, CAST(sum(medium) AS BIGINT) AS medium_found, CAST(sum(low) AS BIGINT) AS low_found,
    (SELECT id FROM history ORDER BY ts DESC, id DESC LIMIT 1) AS latest_scan FROM history)
SELECT *, {grade('average_score')} AS grade FROM k""",
    "rules_per_language": MERGED + f"""SELECT language, count(*) AS rules FROM (
  SELECT unnest(string_split(languages, ',')) AS language FROM merged WHERE languages <> '')
GROUP BY language ORDER BY rules DESC, language LIMIT {fv.TOP_LANGUAGES}""",
    "rules_info": MERGED + "SELECT position, id, name, category, severity, has_multi_line_patterns FROM merged",
    "scan_summary": EVERYTHING + f""", scanned AS (SELECT repo, count(*) FILTER (WHERE listed) AS files_scanned FROM files GROUP BY repo),
s AS (SELECT repo, count(*) AS total, {', '.join(f"{n_of('severity', x)} AS {x.lower()}" for x in fv.SEVERITY_ORDER)},
  {', '.join(f"{n_of('match_type', x)} AS {x.replace('-', '_')}" for x in fv.MATCH_TYPES)},
  {score(f'sum({WEIGHT})')} AS score FROM everything GROUP BY repo)
SELECT repo, {', '.join(f"coalesce({c}, 0) AS {c}" for c in ('total', *(x.lower() for x in fv.SEVERITY_ORDER), *(x.replace('-', '_') for x in fv.MATCH_TYPES)))},
  coalesce(score, 100) AS score, coalesce({grade('score')}, 'A+') AS grade, files_scanned FROM s FULL JOIN scanned USING (repo)""",
    "languages_detected": f"""WITH {SELECTED}
SELECT repo, coalesce(string_agg(language, ',' ORDER BY language) FILTER (WHERE language <> 'unknown'), '') AS languages
FROM (SELECT DISTINCT repo, language FROM src) GROUP BY repo""",
    "executive_summary": ON_CORPUS + ", s AS (" + per_repo(
        f"count(rule_id) AS total, {', '.join(n_of('severity', x) + ' AS ' + x.lower() for x in fv.SEVERITY_ORDER)}, "
        f"{score(f'sum({WEIGHT})')} AS score") + f""")
SELECT repo, 1 AS position, 'Total Vulnerabilities' AS metric, CAST(total AS VARCHAR) AS value FROM s
{' '.join(f"UNION ALL SELECT repo, {i}, '{x}', CAST({x.lower()} AS VARCHAR) FROM s" for i, x in enumerate(fv.SEVERITY_ORDER, 2))}
UNION ALL SELECT repo, 6, 'Security Score', CAST(CAST(score AS INTEGER) AS VARCHAR) || '/100' FROM s
UNION ALL SELECT repo, 7, 'Security Grade', {grade('score')} FROM s""",
    "distinct_categories": EVERYTHING + "SELECT DISTINCT category FROM everything",
    "dedupe_multi_line": findings(MULTILINE) + """SELECT file_path, rule_id, count(*) AS kept, min(line_number) AS first_line,
  max(line_end) AS last_line FROM findings WHERE match_type = 'multi-line' GROUP BY ALL""",
    "number_findings": NUMBERED + "SELECT repo, file_path, rule_id, line_number, code_snippet, finding_number, findings_in_group FROM numbered",
    "first_20": NUMBERED + f"""SELECT repo, finding_number, file_path, rule_id, line_number,
  greatest(findings_in_group - {FIRST}, 0) AS remaining FROM numbered WHERE finding_number <= {FIRST}""",
    "order_by_severity": ON_CORPUS + f"SELECT {SHORT} FROM findings ORDER BY {RANK}, file_path, line_number, rule_ord",
    "canonical_order": EVERYTHING + f"SELECT repo, {SHORT} FROM everything ORDER BY repo, pass_ord > 1, file_path, pass_ord, line_number, rule_ord",
    "number_findings_of_files": numbered("") + "SELECT repo, file_path, rule_id, line_number, finding_number FROM numbered",
    "scan_trend": HISTORY + f"""SELECT id, source, critical, high, medium, low
FROM (SELECT * FROM history ORDER BY ts DESC, id DESC LIMIT {fv.TREND_SCANS}) ORDER BY ts, id""",
    "all_findings": EVERYTHING + f"SELECT repo, language, {SHORT}, rule_name, category, matched_pattern FROM everything",
    "npm_all_deps": f"""WITH {MANIFESTS} SELECT path, package, version FROM packages
WHERE ecosystem = 'npm' AND package NOT IN ('lodash', 'ws')
UNION ALL SELECT path, 'lodash', '9.9.9' FROM manifest WHERE manifest_id % 4 = 0
UNION ALL SELECT path, 'ws', '^9' FROM manifest WHERE manifest_id % 4 = 0""",
    "npm_packages": ADVISED + ", version FROM packages WHERE ecosystem = 'npm'",
    "npm_unpinned": f"WITH {MANIFESTS} SELECT path, package, version FROM unpinned WHERE ecosystem = 'npm'",
    "npm_clean_version": f"WITH {MANIFESTS} SELECT path, package, {CLEAN} AS clean FROM packages WHERE ecosystem = 'npm'",
    "pypi_requirements": ADVISED + ", operator, version FROM packages WHERE ecosystem = 'pypi'",
    "pypi_unpinned": ADVISED + " FROM unpinned WHERE ecosystem = 'pypi'",
    "manifest_dispatch": f"WITH {MANIFESTS} SELECT path, {pick(['npm', 'pypi', 'go', 'cargo'], 'manifest_id % 4')} AS ecosystem FROM manifest",
    "dependency_rule_ids": f"WITH {ISSUES} SELECT ecosystem, rule_id, issue_type, severity, count(*) AS issues FROM issues GROUP BY ALL",
    "dependency_findings": f"""WITH {ISSUES} SELECT rule_id, rule_name, category, severity, file_path,
  CAST(line_number AS INTEGER) AS line_number, code_snippet, description, remediation, match_type, cwe, owasp FROM dep_findings""",
    "secret_findings": SECRETS + f"SELECT repo, {SHORT}, code_snippet FROM findings",
    "catalogue_findings": findings(CATALOGUE, multi_line=False) + "SELECT file_path, rule_id, line_number, matched_pattern FROM findings",
    "catalogue_secrets": findings(CATALOGUE, secrets_from="src", language_rules_too=False) + f"SELECT {SHORT}, code_snippet FROM findings",
    "custom_pack_findings": f"""WITH brands AS (
  SELECT *, CAST(substr(p_brand, 7) AS INTEGER) AS n, {pick(d.BRAND_FILES, f'p_partkey % {len(d.BRAND_FILES)}')} AS ext FROM part)
SELECT CASE n WHEN 1 THEN {lit(d.REPLACED_RULE)} ELSE 'PACK-' || n END AS rule_id,
  {pick([x.capitalize() for x in d.BRAND_SEVERITIES], f'n % {len(d.BRAND_SEVERITIES)}')} AS severity,
  'parts/p' || p_partkey || ext AS file_path, CAST(3 AS INTEGER) AS line_number, CAST(NULL AS INTEGER) AS line_end,
  'single-line' AS match_type, p_brand AS rule_name
FROM brands WHERE ext = '.py' OR n % 2 = 1""",
    "stream_scan": ON_CORPUS + f"SELECT repo, {SHORT} FROM findings",
    "stream_all_findings": EVERYTHING + f"SELECT repo, language, {SHORT}, rule_name, category, matched_pattern FROM everything",
    "stream_daily_kpis": f"""SELECT strftime(ts, '%Y-%m-%d') AS day,
  count(*) FILTER (WHERE event_type IN ('error', 'signup', 'purchase', 'view')) AS total, {n_of('event_type', 'error')} AS critical,
  {n_of('event_type', 'signup')} AS high, {n_of('event_type', 'purchase')} AS medium, {n_of('event_type', 'view')} AS low
FROM events GROUP BY ALL""",
}
