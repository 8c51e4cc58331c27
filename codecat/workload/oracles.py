"""The registered queries in DuckDB SQL, over the raw tables."""

from __future__ import annotations

from ..functions.code import TRIMMED

# The derived tree, written apart from the Spark side of it.
FILES = """
WITH b AS (SELECT doc_id AS d, CAST(doc_id AS STRING) AS i, doc_id % 4 AS k, CAST(doc_id % 7 AS STRING) AS m,
             CASE WHEN doc_id % 3 = 0 THEN '0' ELSE CAST(doc_id // 40 AS STRING) END AS p, text FROM documents),
j AS (SELECT *, '/home/dev/idx/java/sources/' AS r FROM b WHERE k = 0),
y AS (SELECT *, '/home/dev/p' || p || '/.venv' AS v,
        '/home/dev/p' || p || '/.venv/lib/python3.' || CASE WHEN d % 5 < 2 THEN '10' ELSE '9' END || '/site-packages/pkg' || m AS dir
      FROM b WHERE k = 1),
s AS (SELECT *, CASE WHEN d % 5 = 0 THEN '/home/dev/.cache' WHEN d % 5 = 1 THEN '/home/dev/anaconda3/x' ELSE '/home/dev/app' || p END
        || '/node_modules/' || CASE m WHEN '1' THEN '@scope/p1' WHEN '2' THEN '.hid/p2' ELSE 'p' || m END AS dir
      FROM b WHERE k = 2),
g AS (SELECT *, '/home/dev/go/pkg/mod/example.com/m' || m || '@v1.' || p AS dir FROM b WHERE k = 3)
SELECT r || CASE WHEN d % 11 = 0 THEN 'jdk/java.base/java/util/' WHEN d % 13 = 0 THEN 'jdk/java.base/jdk/internal/misc/'
            ELSE 'org/acme' || m || '/lib/1.' || p || '/org/acme/' END
         || CASE WHEN d % 17 = 0 THEN 'package-info' ELSE 'Doc' || i END || '.java' AS path,
       CASE WHEN d % 19 = 0 THEN '' ELSE '/* hdr */' || chr(10) || 'package org.acme' || m || ';' || chr(10) END
         || 'public class Doc' || i || ' {' || chr(10) || '  /* record Draft (unused) */' || chr(10) || '  * interface Note' || chr(10)
         || '  private record Page(int n) {}' || chr(10) || ' /* package */ enum Stage { OPEN } interface Reader {}' || chr(10) || text || chr(10) || '}' AS content FROM j
UNION ALL SELECT dir || '/m' || i || '.py', text FROM y
UNION ALL SELECT DISTINCT dir || '/__init__.py', '' FROM y WHERE m <> '3'
UNION ALL SELECT DISTINCT v || '/pyvenv.cfg', 'version = 3.11' FROM y
UNION ALL SELECT dir || CASE d % 11 WHEN 0 THEN '/lib/f' || i || '.ts' WHEN 1 THEN '/lib/f' || i || '.json' WHEN 2 THEN '/node_modules/q/f' || i || '.js'
            WHEN 3 THEN '/.h/f' || i || '.jsx' ELSE '/f' || i || '.js' END, text FROM s
UNION ALL SELECT DISTINCT dir || '/package.json', CASE m WHEN '4' THEN '{"name":"p4"}' WHEN '5' THEN '{bad' ELSE '{"name":"p' || m || '","version":"1.0.' || m || '"}' END FROM s
UNION ALL SELECT DISTINCT dir || '/node_modules/q/package.json', '{"name":"q","version":"2.0.0"}' FROM s WHERE d % 11 = 2
UNION ALL SELECT dir || CASE d % 11 WHEN 0 THEN '/f' || i || '_test.go' WHEN 1 THEN '/sub/f' || i || '.go' ELSE '/f' || i || '.go' END, text FROM g
UNION ALL SELECT DISTINCT dir || '/go.mod', CASE m WHEN '6' THEN 'go 1.24' WHEN '5' THEN '// c' || chr(10) || 'module "example.com/q5"' ELSE 'module example.com/m' || m || chr(10) || 'go 1.24' END FROM g
UNION ALL SELECT DISTINCT dir || '/sub/go.mod', 'module example.com/sub' || m FROM g WHERE d % 11 = 1
"""

ARTIFACTS = """
SELECT DISTINCT '/home/dev/.m2/' || CASE WHEN p_partkey % 9 = 0 THEN 'repo/' ELSE 'repository/' END
    || CASE p_partkey % 5 WHEN 0 THEN 'repository/x/' WHEN 1 THEN 'org/acme/' WHEN 2 THEN '' ELSE 'com/b' || CAST(p_partkey % 3 AS STRING) || '/' END
    || 'lib' || CAST(p_partkey % 11 AS STRING) || '/1.' || CAST(p_partkey % 4 AS STRING) || '/lib' || CAST(p_partkey % 11 AS STRING)
    || CASE WHEN p_partkey % 8 = 3 THEN '-9' ELSE '-1.' || CAST(p_partkey % 4 AS STRING) END
    || CASE p_partkey % 6 WHEN 0 THEN '-sources.jar' WHEN 1 THEN '-javadoc.jar' WHEN 2 THEN '-tests-sources.jar' WHEN 3 THEN '.jar' WHEN 4 THEN '.pom' ELSE '-sources.jar.sha1' END AS path
FROM part
"""

JVM = """
SELECT DISTINCT '/hosts/h' || CAST(c_custkey - c_custkey % 20 AS STRING) || '/usr/lib/jvm/java-' || CAST(8 + c_custkey % 11 AS STRING)
    || '-openjdk-' || CASE WHEN c_custkey % 2 = 0 THEN 'amd64' ELSE 'arm64' END
    || '/lib/' || CASE WHEN c_custkey % 3 = 0 THEN 'modules' ELSE 'src.zip' END AS path
FROM customer
"""


def _parts_ctes(src: str, t: str) -> str:
    """Paths taken apart. ``t`` tags the names, so that two corpora fit in one query."""
    return f"""
f{t} AS (SELECT path, content, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS base,
           array_to_string(string_split(path, '/')[:-2], '/') AS dir FROM {src})"""


def _java_ctes(t: str) -> str:
    return f"""
jf{t} AS (SELECT * FROM f{t} WHERE contains(path, '/java/sources/') AND ends_with(path, '.java')
            AND base NOT IN ('package-info.java', 'module-info.java')),
jp{t} AS (SELECT path, regexp_replace(base, '\\.[^.]*$', '') AS top, CASE WHEN contains(path, '/jdk/')
            THEN replace(trim(regexp_replace(regexp_replace(dir || '/', '^.*?/jdk/', '/jdk/'), '/jdk/[^/]*', '', 'g'), '/'), '/', '.')
            ELSE nullif(regexp_extract(content, 'package\\s+([a-zA-Z0-9_.]+);', 1), '') END AS package FROM jf{t}),
jr{t} AS (SELECT path, string_split(replace(content, '/* package */', ''), chr(10)) AS lines FROM jf{t}),
ju{t} AS (SELECT path, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS line FROM jr{t}),
jl{t} AS (SELECT path, line_no, trim(line, '{TRIMMED}') AS line FROM ju{t}
            WHERE NOT regexp_matches(trim(line, '{TRIMMED}'), '^(//|/\\*|\\*/|\\*)(\\s|$)')),
jt{t} AS (SELECT DISTINCT path, unnest(regexp_extract_all(line, '(?:class|interface|record|enum)\\s+([a-zA-Z0-9_$]+)', 1)) AS type FROM jl{t}),
java{t} AS (SELECT package || '.' || top || CASE WHEN type = top THEN '' ELSE '.' || type END AS name, path
            FROM jt{t} JOIN jp{t} USING (path) WHERE package IS NOT NULL)"""


def _python_ctes(t: str) -> str:
    return f"""
ve{t} AS (SELECT DISTINCT dir AS venv FROM f{t} WHERE base = 'pyvenv.cfg'),
sp{t} AS (SELECT DISTINCT array_to_string(parts[:i], '/') AS site FROM
            (SELECT parts, unnest(range(1, len(parts))) AS i FROM f{t}) WHERE parts[i] = 'site-packages'),
st{t} AS (SELECT venv, arg_max(site, string_split(site, '/')) AS site_packages FROM ve{t} JOIN sp{t}
            ON starts_with(site || '/', venv || '/') AND NOT list_contains(
              string_split(site, '/')[len(string_split(venv, '/')):len(string_split(site, '/')) - 1], 'site-packages')
            GROUP BY venv),
pm{t} AS (SELECT venv, site_packages, replace(regexp_replace(regexp_replace(regexp_replace(replace(path, site_packages, ''),
            '^/', ''), '/__init__\\.py$', ''), '\\.py$', ''), '/', '.') AS name, path
          FROM f{t} JOIN st{t} ON starts_with(path, site_packages || '/')
          WHERE ends_with(path, '.py') AND dir IN (SELECT dir FROM f{t} WHERE base = '__init__.py'))"""


def _npm_ctes(t: str) -> str:
    return f"""
nr{t} AS (SELECT *, substr(path, 1, strpos(path, '/node_modules/') + 12) AS root FROM f{t} WHERE contains(path, '/node_modules/')),
ne{t} AS (SELECT * FROM nr{t} WHERE NOT contains(root, '/.') AND NOT contains(root, '/anaconda3/')),
nm{t} AS (SELECT * FROM ne{t} WHERE base = 'package.json' AND NOT contains(substr(dir, length(root) + 1), '/.')),
nt{t} AS (SELECT * FROM nm{t} a WHERE NOT EXISTS (SELECT 1 FROM nm{t} o WHERE o.dir <> a.dir AND starts_with(a.dir, o.dir || '/'))),
nv{t} AS (SELECT *, json_valid(content) AND json_type(content, '$.name') = 'VARCHAR' AND json_type(content, '$.version') = 'VARCHAR' AS ok
          FROM (SELECT * REPLACE (CASE WHEN json_valid(content) THEN content END AS content) FROM nt{t})),
np{t} AS (SELECT root, dir, replace(path, root, '') AS manifest, json_extract_string(content, '$.name') AS name,
            json_extract_string(content, '$.version') AS version FROM nv{t} WHERE ok),
no{t} AS (SELECT e.root, p.name AS package, version, substr(path, length(e.root) + 2) AS name, path
          FROM ne{t} e JOIN np{t} p ON starts_with(path, p.dir || '/') WHERE regexp_matches(base, '\\.(js|ts|jsx|tsx)$'))"""


def _go_ctes(t: str) -> str:
    return f"""
gm{t} AS (SELECT dir AS mod_dir, path, regexp_extract(content, '(?m)^module\\s+([^\\s]+)', 1) AS found FROM f{t} WHERE base = 'go.mod'),
gn{t} AS (SELECT mod_dir, trim(found, '"') AS module FROM gm{t} WHERE found <> ''),
gf{t} AS (SELECT module || substr(path, length(mod_dir) + 1) AS name, path FROM f{t} JOIN gn{t} ON starts_with(path, mod_dir || '/')
          WHERE ends_with(path, '.go') AND NOT contains(base, '_test.go'))"""


def _catalogue_ctes(src: str = "files", t: str = "") -> str:
    ctes = [_parts_ctes(src, t), _java_ctes(t), _python_ctes(t), _npm_ctes(t), _go_ctes(t)]
    return ",".join(ctes) + f""",
cat{t} AS (SELECT 'java' AS language, name, path FROM java{t} UNION SELECT 'python', name, path FROM pm{t}
       UNION SELECT 'javascript', name, path FROM no{t} UNION SELECT 'go', name, path FROM gf{t})"""


_SOURCE = f"WITH files AS ({FILES})"
_PARTS = f"{_SOURCE},{_parts_ctes('files', '')}"
_JAVA = f"{_PARTS},{_java_ctes('')}"
_PYTHON = f"{_PARTS},{_python_ctes('')}"
_NPM = f"{_PARTS},{_npm_ctes('')}"
_GO = f"{_PARTS},{_go_ctes('')}"
_CATALOGUE = f"{_SOURCE},{_catalogue_ctes()}"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAME_LC = f"translate(name, '{_UPPER}', '{_LOWER}')"

_ARTIFACTS = f"""
WITH src AS (SELECT path, string_split(path, '/') AS parts FROM ({ARTIFACTS})
             WHERE ends_with(path, '-sources.jar') OR ends_with(path, '-javadoc.jar')),
at1 AS (SELECT *, list_max(list_filter(range(1, len(parts) - 2), lambda i: parts[i] = 'repository')) AS i FROM src),
bad AS (SELECT path FROM at1 WHERE i IS NULL),
c AS (SELECT path, array_to_string(parts[i + 1:-4], '.') AS group_id, parts[-3] AS artifact_id, parts[-2] AS version,
        regexp_replace(parts[-1], '\\.[^.]*$', '') AS stem FROM at1 WHERE i IS NOT NULL),
d AS (SELECT path, group_id, artifact_id, version,
        CASE WHEN starts_with(stem, artifact_id || '-' || version || '-')
             THEN substr(stem, length(artifact_id || '-' || version || '-') + 1) ELSE '' END AS classifier FROM c),
artifacts AS (SELECT *, concat_ws('/', nullif(classifier, ''), nullif(replace(group_id, '.', '/'), ''), artifact_id, version) AS out_dir FROM d)"""

_JDKS = f"""
jv AS (SELECT path, parts, array_to_string(parts[:-4], '/') AS jvm_root, parts[-3] AS jdk
       FROM (SELECT path, string_split(path, '/') AS parts FROM ({JVM})) WHERE ends_with(path, '/lib/src.zip')),
jdks AS (SELECT jvm_root, version, arg_min(path, jdk) AS path FROM jv JOIN (VALUES ('8'), ('11'), ('1')) v(version)
         ON regexp_matches(jdk, '^java-' || version || '([^0-9]|$)') GROUP BY jvm_root, version)"""

_RESOLVED = "SELECT language, name, min(path) AS path FROM cat GROUP BY language, name"

_ARCHIVES = """
WITH b AS (SELECT doc_id AS d, CAST(doc_id AS STRING) AS i, CAST(doc_id % 7 AS STRING) AS m, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE CAST(doc_id // 40 AS STRING) END AS p, text FROM documents),
a AS (SELECT *, CASE WHEN d % 50 = 0 THEN '/hosts/h' || i || '/usr/lib/jvm/java-17-openjdk/lib/src.zip'
        ELSE '/home/dev/.m2/repository/org/acme' || m || '/lib' || i || '/1.' || p || '/lib' || i || '-1.' || p || '-sources.jar' END AS archive,
        '/home/dev/idx/java/' || CASE WHEN d % 50 = 0 THEN 'sources/17/hosts/h' || i || '/usr/lib/jvm/jdk' ELSE 'sources/org/acme' || m || '/lib' || i || '/1.' || p END AS out FROM b)"""

_REJECTED = f"""{_CATALOGUE}
    SELECT path, 'java' AS stage, 'no package' AS reason FROM jp WHERE package IS NULL
    UNION ALL SELECT path, 'java', 'no types' FROM jp WHERE package IS NOT NULL AND path NOT IN (SELECT path FROM jt)
    UNION ALL SELECT venv || '/pyvenv.cfg', 'python', 'no site-packages' FROM ve WHERE venv NOT IN (SELECT venv FROM st)
    UNION ALL SELECT path, 'javascript', 'bad manifest' FROM nv WHERE ok IS NOT TRUE
    UNION ALL SELECT path, 'go', 'no module name' FROM gm WHERE found = ''"""

_EXPANDED = f"""{_ARCHIVES} SELECT 'java' AS language, CASE WHEN d % 50 = 0 THEN '' ELSE 'org.' END || 'acme' || m || '.Doc' || i AS name,
                out || '/org/acme' || m || '/Doc' || i || '.java' AS path FROM a WHERE d % 23 <> 0"""


def oracles() -> dict[str, str]:
    """SQL by query key."""
    return {
        "scan_files": f"{_SOURCE} SELECT path, CAST(length(content) AS BIGINT) AS chars FROM files",
        "marker_files": f"""{_PARTS} SELECT path, dir, base AS marker FROM f
            WHERE base IN ('pyvenv.cfg', '__init__.py', 'package.json', 'go.mod')""",
        "filter_suffix": f"{_PARTS} SELECT path FROM f WHERE regexp_matches(path, '\\.(js|ts|jsx|tsx)$')",
        "path_ancestors": f"""{_PARTS} SELECT path, coalesce(nullif(array_to_string(parts[:i], '/'), ''), '/') AS ancestor
            FROM (SELECT path, parts, unnest(range(1, len(parts))) AS i FROM f)""",
        "code_lines": f"{_JAVA} SELECT path, line_no, line FROM jl",
        "java_packages": f"{_JAVA} SELECT path, package FROM jp WHERE package IS NOT NULL",
        "java_symbols": f"{_JAVA} SELECT name, path FROM java",
        "site_packages": f"{_PYTHON} SELECT venv, site_packages FROM st",
        "python_modules": f"{_PYTHON} SELECT venv, site_packages, name, path FROM pm",
        "npm_roots": f"{_NPM} SELECT DISTINCT root FROM ne",
        "npm_packages": f"{_NPM} SELECT root, dir, manifest, name, version FROM np",
        "npm_modules": f"{_NPM} SELECT root, package, version, name, path FROM no",
        "go_modules": f"{_GO} SELECT mod_dir, module FROM gn",
        "go_files": f"{_GO} SELECT name, path FROM gf",
        "build_catalogue": f"{_CATALOGUE} SELECT language, name, path FROM cat",
        "tree_files": f"""{_SOURCE} SELECT path, CAST(strlen(coalesce(content, '')) AS BIGINT) AS bytes, md5(coalesce(content, '')) AS digest FROM files""",
        "index_rejects": _REJECTED,
        "index_kept_rejects": _REJECTED,
        "stream_rejects": _REJECTED,
        "index_archives": _EXPANDED,
        "stream_archives": _EXPANDED,
        "index_stored_rejects": f"""{_ARCHIVES} SELECT archive AS path, 'archive' AS stage, 'bad archive: BadZipFile' AS reason FROM a WHERE d % 23 = 0
            UNION ALL SELECT archive || '!../evil' || i || '.txt', 'archive', 'entry leaves its directory' FROM a WHERE d % 23 <> 0""",
        "index_extracted": f"{_ARCHIVES} SELECT replace(out, '/home/dev/idx/java/', '') AS out_dir FROM a",
        "index_reset": f"{_CATALOGUE} SELECT language, name, path FROM cat WHERE language <> 'java'",
        "search_stored": f"""{_CATALOGUE} SELECT language, name, path FROM cat WHERE language = 'python' AND {_NAME_LC} LIKE '%pkg%m%'
            UNION ALL SELECT language, name, path FROM cat WHERE {_NAME_LC} LIKE 'example.com/m_/f%3.go'""",
        "catalogue_counts": f"{_CATALOGUE} SELECT language, count(*) AS documents FROM cat GROUP BY language",
        "index_upsert": f"{_CATALOGUE} SELECT language, name, path FROM cat",
        "incremental_index": f"""{_SOURCE}, early AS (SELECT * FROM files WHERE length(path) % 3 <> 0),
            {_catalogue_ctes("early", "1")}, {_catalogue_ctes("files", "2")}
            SELECT language, name, path FROM cat1 UNION SELECT language, name, path FROM cat2""",
        "search_fuzzy": f"""{_CATALOGUE} SELECT language, name, path FROM cat WHERE {_NAME_LC} LIKE '%doc%1%r%'""",
        "search_exact": f"""{_CATALOGUE} SELECT language, name, path FROM cat WHERE {_NAME_LC} LIKE 'example.com/m_/f%3.go'""",
        "search_lang": f"""{_CATALOGUE} SELECT language, name, path FROM cat WHERE language = 'python' AND {_NAME_LC} LIKE '%pkg%m%'""",
        "search_batch": f"""{_CATALOGUE}, asked AS (
            SELECT p_partkey AS qid, CASE p_partkey % 4 WHEN 0 THEN '%Doc' || CAST(p_partkey AS STRING) || '%Page%'
                WHEN 1 THEN '%F' || CAST(p_partkey AS STRING) || '.%' WHEN 2 THEN '%_kg%m' || CAST(p_partkey AS STRING)
                ELSE 'org.acme%Doc' || CAST(p_partkey AS STRING) END AS pattern,
                CASE p_partkey % 3 WHEN 0 THEN 'Java' WHEN 1 THEN 'go' END AS language FROM part)
            SELECT qid, c.language, name, path FROM asked q JOIN cat c ON (q.language IS NULL OR lower(q.language) = c.language)
                AND {_NAME_LC} LIKE translate(pattern, '{_UPPER}', '{_LOWER}')""",
        "search_listing": f"{_CATALOGUE} SELECT DISTINCT language || chr(9) || name AS line FROM cat ORDER BY line",
        "resolve_name": f"{_CATALOGUE} {_RESOLVED}",
        "lookup_content": f"""{_CATALOGUE}, r AS ({_RESOLVED})
            SELECT language, name, path, content FROM r JOIN files USING (path) WHERE {_NAME_LC} LIKE '%f%1%'""",
        "render_source": f"""{_CATALOGUE}, r AS ({_RESOLVED})
            SELECT language, name, path, CASE WHEN language = 'python' THEN '# ' ELSE '// ' END || path || chr(10) || chr(10) || content AS source
            FROM r JOIN files USING (path) WHERE {_NAME_LC} LIKE '%m%2%'""",
        "fuzzy_pattern": """SELECT doc_id, '%' || regexp_replace(text, '\\s+', '%', 'g') || '%' AS pattern FROM documents""",
        "language_code": """SELECT doc_id, lang_name, CASE lower(lang_name) WHEN 'java' THEN 0 WHEN 'python' THEN 1 WHEN 'javascript' THEN 2
                WHEN 'go' THEN 3 ELSE -1 END AS code
            FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Java' WHEN 1 THEN 'PYTHON' WHEN 2 THEN 'javascript' WHEN 3 THEN 'Go' WHEN 4 THEN ''
                ELSE lang END AS lang_name FROM documents)""",
        "language_name": """SELECT doc_id, CAST(doc_id % 6 - 1 AS INTEGER) AS code, CASE doc_id % 6 WHEN 1 THEN 'java' WHEN 2 THEN 'python'
                WHEN 3 THEN 'javascript' WHEN 4 THEN 'go' ELSE '' END AS name FROM documents""",
        "maven_artifacts": f"{_ARTIFACTS} SELECT path, group_id, artifact_id, version, classifier FROM artifacts",
        "maven_rejects": f"{_ARTIFACTS} SELECT path, 'maven' AS stage, 'bad path' AS reason FROM bad",
        "artifact_out_dir": f"{_ARTIFACTS} SELECT path, out_dir FROM artifacts",
        "maven_sources": f"{_ARTIFACTS} SELECT path, out_dir FROM artifacts WHERE classifier = 'sources'",
        "new_artifacts": f"""{_ARTIFACTS} SELECT out_dir, arg_min(path, string_split(path, '/')) AS path FROM artifacts
            WHERE out_dir NOT IN (SELECT out_dir FROM artifacts WHERE version = '1.0') GROUP BY out_dir""",
        "jdk_archive": f"WITH {_JDKS} SELECT jvm_root, version, path FROM jdks",
        "java_sources": f"""{_ARTIFACTS}, {_JDKS} SELECT arg_min(path, string_split(path, '/')) AS path, out_dir FROM artifacts GROUP BY out_dir
            UNION ALL SELECT path, 'sources/' || version || jvm_root || '/jdk' FROM jdks""",
        "expand_archives": f"""{_ARCHIVES}
            SELECT archive, out || '/org/acme' || m || '/Doc' || i || '.java' AS path,
                md5('package org.acme' || m || ';' || chr(10) || 'public class Doc' || i || ' {{}}' || chr(10) || text) AS digest, '' AS reason
            FROM a WHERE d % 23 <> 0
            UNION ALL SELECT archive, out || '/a/b/c/d/' || i || '.txt', md5(text || text), '' FROM a WHERE d % 23 <> 0
            UNION ALL SELECT archive, '../evil' || i || '.txt', '', 'entry leaves its directory' FROM a WHERE d % 23 <> 0
            UNION ALL SELECT archive, '', '', 'bad archive: BadZipFile' FROM a WHERE d % 23 = 0""",
    }
