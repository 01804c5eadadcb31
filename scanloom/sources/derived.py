"""Inputs derived from the given tables: code corpora, manifests, scan history and text rows.

The tables hold prose, parts and events; these plans put known lines of code into the prose, and shape parts and
events as manifests and scans, by arithmetic on the keys, so that every scan runs over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.reuse import built_once
from scanloom.functions.scoring import grade, score_of_penalty
from scanloom.sources.files import dealt

CORPUS_DIRS = ["src", "src/api", "node_modules/x", "lib", "vendor", "app/Build", "infra", "docs"]

# File name, line A, line B.
CORPUS_FILES = [
    ("main.js", "el.innerHTML = msg;", 'db.query("SELECT a" + id + "x");'),
    ("view.tsx", "const r = eval(x);", 'localStorage.setItem("token", t);'),
    ("index.php", "$h = md5($p);", "echo $_GET['name'];"),
    ("util.py", "h = hashlib.md5(b)", "except:"),
    ("Main.java", "Runtime.getRuntime().exec(cmd);", 'String password = "abcd1234";'),
    ("lib.c", "strcpy(a, b);", "system(cmd);"),
    ("svc.go", 'token := "abcd1234"', "rows := db.Query(fmt.Sprintf(q, id))"),
    ("job.rb", "YAML.load(s)", "x = 1"),
    ("deploy.sh", "chmod 777 /srv", "eval $CMD"),
    ("q.sql", "GRANT ALL PRIVILEGES ON db TO app;", "EXEC (@stmt)"),
    ("Dockerfile", "FROM node:latest", "USER root"),
    ("main.tf", "encrypted = false", 'cidr_blocks = ["0.0.0.0/0"]'),
    ("pod.yaml", "privileged: true", "image: nginx"),
    ("App.kt", 'val password = "abcd1234"', 'db.rawQuery("SELECT $id", null)'),
    ("App.swift", 'let token = "abcd1234"', "NSAllowsArbitraryLoads true"),
    ("data.json", '{"a": 1}', '{"b": 2}'),
    ("NOTES", "TODO later", "import os"),
]

# Suffix, block.
MULTILINE_BLOCKS = [
    (".php", "$q = <<<SQL\nSELECT $x\nSQL;"),
    (".js", 'fetch("http://a/\n$id")'),
    (".py", 'requests.get(f"http://h/{\nuser}")'),
    (".py", "subprocess.run(cmd,\n  shell=True)"),
]

# File name, lines; every live rule of the language matches one of them.
CATALOGUE_FILES = [
    ("main.js", ["user.isAdmin = true;", "const h = sha1(x);", 'const q = "SELECT a" + id + " FROM t";', "db.query(`SELECT ${a} FROM t`);",
                 "document.write(x);", "child_process.exec(base + arg);", "app.post('/login', handler);", 'const token = "abcd";',
                 "debug: true,", "const _ = require('lodash');", "sessionStorage.setItem('token', t);", "const f = JSON.parse(s);",
                 "console.log(password);", "fetch($url);", "function f(a) { return a }", "multer({dest: d});"]),
    ("index.php", ["if (!isset($_SESSION['user'])) exit;", "$h = md5($p);", "mysql_query($q);", "$a = <<<SQL SELECT $x SQL;",
                   "echo $_GET['name'];", "shell_exec($c);", "$password = 'abcd';", "session_start();", "error_log($e);",
                   "readfile($f);", "$f = $_FILES['a'];", "unserialize($s);"]),
    ("app.py", ["@app.route('/x')", "h = hashlib.sha1(b)", "f = Fernet('abcdefghijkl')", "cursor.execute('select %s')",
                "render_template_string(t)", "eval(request.data)", "@app.route('/login')", "SECRET_KEY = 'abcd'", "DEBUG = True",
                "import pickle", "SESSION_COOKIE_SECURE = False", "if len(password) < 8:", "pickle.loads(b)", "print(request)",
                "requests.get(request.url)", "except:", "request.args.get('a')"]),
    ("Main.java", ['st.executeQuery("SELECT a FROM t WHERE b = " + b);', "Runtime.getRuntime().exec(cmd);",
                   'MessageDigest.getInstance("MD5");', 'String password = "abcd1234";', "in.readObject();",
                   "DocumentBuilderFactory.newInstance();", "new SearchControls();"]),
    ("lib.c", ["strcpy(a, b);", "printf(msg);", "system(cmd);", "int r = rand();", "free(p); free(p);"]),
    ("App.cs", ['new SqlCommand("SELECT a" + b);', "new BinaryFormatter();", 'string password = "abcd1234";', "new DirectorySearcher();"]),
    ("svc.go", ["db.Query(fmt.Sprintf(q, id))", 'exec.Command("sh", "-c", c)', 'token := "abcd1234"', "http.Get(url)"]),
    ("job.rb", ["eval(s)", 'where("a = #{b}")', "YAML.load(s)"]),
    ("deploy.sh", ["eval $CMD", 'TOKEN="abcd1234"', "chmod 777 /srv"]),
    ("setup.ps1", ["Invoke-Expression $c", "$Password = 'abcd1234'", "$w.DownloadString('u')"]),
    ("q.sql", ["EXEC (@stmt)", "GRANT ALL PRIVILEGES ON db TO app;"]),
    ("Dockerfile", ["FROM node:latest", "USER root", "ADD https://h/a", "# --privileged"]),
    ("main.tf", ['cidr_blocks = ["0.0.0.0/0"]', 'secret = "abcd1234"', "encrypted = false"]),
    ("pod.yaml", ["privileged: true", "image: nginx", "password: abcd1234"]),
    ("App.kt", ['val password = "abcd1234"', 'db.rawQuery("SELECT $id", null)']),
    ("App.swift", ['let token = "abcd1234"', "NSAllowsArbitraryLoads true"]),
    ("App.scala", ['SQL(s"SELECT $x")']),
]

# One line for each kind of secret; none is a real one.
SECRET_LINES = [
    "AKIA" + "A" * 16, "ghp_" + "a" * 36, "xoxb-" + "1" * 12, "AIza" + "b" * 35, "sk_live_" + "c" * 16,
    "eyJ" + "d" * 8 + ".eyJ" + "e" * 8 + ".f", "-----BEGIN PRIVATE KEY-----", "password = 'abcd1234'", "db://user:word@host",
]

# Languages of the rules made of brands, and of the files made of parts.
BRAND_LANGUAGES = [["python"], ["python", "golang"]]
BRAND_SEVERITIES = ["low", "HIGH", "Critical"]
BRAND_FILES = [".py", ".go"]
REPLACED_RULE = "BP-PY-001"

NPM_NAMES = ["lodash", "jquery", "axios", "express", "ws", "ejs", "vm2", "chalk", "react", "vue", "left-pad", "Moment",
             "semver", "tar", "yaml", "debug", "moment", "minimist", "node-fetch", "glob"]
NPM_VERSIONS = ["^1.2.3", "~2.0", "*", "latest", "1.0.0", ">=3.1", "4.5.6", "x"]
PYPI_NAMES = ["requests", "flask", "Django", "pyyaml", "lxml", "numpy", "pandas", "urllib3", "six", "attrs", "jinja2",
              "httpx", "certifi", "idna", "pytest", "click", "rich", "tqdm", "scipy", "tornado"]
PYPI_SUFFIXES = ["", "==1.0", ">=2.0", "~=3.1", "[extra]==1.0", "  # note"]
GO_LINES = ["require golang.org/x/net v0.1", "require (", "\tgolang.org/x/net v0.1", ")", "// golang.org/x/crypto\tx",
            "replace github.com/dgrijalva/jwt-go\t=> x"]
CARGO_LINES = ['openssl = "0.10"', 'openssl-sys = "0.9"', 'serde = "1"', '  hyper = "1"']
MANIFEST_NAMES = ["package.json", "requirements.txt", "go.mod", "Cargo.toml"]

SCAN_TYPES = ["single_file", "multi_file", "zip", "repository"]

# Language as declared, line added to the text.
DECLARED = [
    ("js", "const r = eval(x);"),
    ("TypeScript", 'localStorage.setItem("token", t);'),
    ("py", "except:"),
    ("golang", 'token := "abcd1234"'),
    ("C#", 'string password = "abcd1234";'),
    ("klingon", "import pickle"),
]

PAGE_LINES = ["document.write(x);", "except:", "plain"]

ONE_LINE_HEREDOC = "$a = <<<SQL SELECT $x SQL;"
HEREDOC = "$b = <<<SQL\nSELECT $y\nSQL;"

CUSTOM_RULE_IDS = ["A02-PHP-001", "A03-JS-002", "BP-PY-001"]
CUSTOM_SEVERITIES = ["low", "HIGH", "Critical", "medium", "bogus", None]
CUSTOM_LANGUAGES = [["python"], ["javascript", "js"], ["go"], [], None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts. A small file is read by one task; the setting ``spark.scanloom.partitions`` deals
    its rows to so many."""
    return dealt(table(spark, sf_dir, name).select(*columns), int(spark.conf.get("spark.scanloom.partitions", "0")))


def pick(values: list[str], index: Column) -> Column:
    """Entry ``index`` (from 0) of a short list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as source files of ten repositories: doc_id, repo, path, content."""
    return corpus_of(texts(spark, sf_dir, "documents", "doc_id", "text"))


def corpus_of(documents: DataFrame) -> DataFrame:
    """Per-row and deterministic, so it serves streams as well."""
    return documents.select(*_corpus_columns())


@built_once
def _corpus_columns() -> list[Column]:
    doc = F.col("doc_id")
    kind = doc % len(CORPUS_FILES)
    variant = F.expr(f"doc_id div {len(CORPUS_FILES)}") % 4
    repo = F.concat(F.lit("repo"), (doc % 10).cast("string"))
    name = pick([n for n, _, _ in CORPUS_FILES], kind)
    line_a = F.when(variant.isin(1, 3), pick([a for _, a, _ in CORPUS_FILES], kind))
    line_b = F.when(variant.isin(2, 3), pick([b for _, _, b in CORPUS_FILES], kind))
    return [
        F.col("doc_id"),
        repo.alias("repo"),
        F.concat_ws("/", repo, pick(CORPUS_DIRS, doc % len(CORPUS_DIRS)), F.concat(F.lit("d"), doc.cast("string")),
                    name).alias("path"),
        F.concat_ws("\n", F.col("text"), line_a, line_b).alias("content"),
    ]


def multiline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with one to three multi-line blocks appended, ``doc_id % 5`` filler lines between them."""
    doc = F.col("doc_id")
    block = pick([b for _, b in MULTILINE_BLOCKS], doc % 4)
    filler = F.repeat(F.lit("x = 1\n"), (doc % 5).cast("int"))
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        F.concat(F.lit("ml/d"), doc.cast("string"), pick([s for s, _ in MULTILINE_BLOCKS], doc % 4)).alias("path"),
        F.concat(F.col("text"), F.lit("\n"), block,
                 F.repeat(F.concat(F.lit("\n"), filler, block), (doc % 3).cast("int"))).alias("content"),
    )


def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as one file each, in turn of every language, with the lines of that language and one kind of secret."""
    doc = F.col("doc_id")
    kind = doc % len(CATALOGUE_FILES)
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        F.concat(F.lit("cat/d"), doc.cast("string"), F.lit("/"), pick([n for n, _ in CATALOGUE_FILES], kind)).alias("path"),
        F.concat_ws("\n", "text", pick(["\n".join(lines) for _, lines in CATALOGUE_FILES], kind),
                    pick(SECRET_LINES, doc % len(SECRET_LINES))).alias("content"),
    )


def brand_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom rule pack as one JSON text, with a rule for each brand of ``part``; Brand#1 takes a built-in rule's id.

    Brands are a fixed list, however many parts there are.
    """
    number = F.substr("p_brand", F.lit(7)).cast("int")
    languages = F.array(*[F.array(*map(F.lit, names)) for names in BRAND_LANGUAGES])
    rule = F.struct(
        F.when(number == 1, F.lit(REPLACED_RULE)).otherwise(F.concat(F.lit("PACK-"), number.cast("string"))).alias("id"),
        F.col("p_brand").alias("name"),
        pick(BRAND_SEVERITIES, number % len(BRAND_SEVERITIES)).alias("severity"),
        F.get(languages, number % len(BRAND_LANGUAGES)).alias("languages"),
        F.array(F.concat("p_brand", F.lit("$"))).alias("patterns"),
    )
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.agg(F.to_json(F.struct(F.array_sort(F.collect_list(rule)).alias("rules"))).alias("json"))


def brand_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as one small file each, whose last line is the brand."""
    key = F.col("p_partkey")
    return texts(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select(
        F.concat(F.lit("parts/p"), key.cast("string"), pick(BRAND_FILES, key % len(BRAND_FILES))).alias("path"),
        F.concat_ws("\n", "p_name", F.lit("except:"), "p_brand").alias("content"),
    )


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted texts with a language named by hand: all turns of ``conversations``."""
    turn = F.col("turn")
    return texts(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("id"),
        pick([d for d, _ in DECLARED], turn % len(DECLARED)).alias("declared_language"),
        F.concat_ws("\n", "text", pick([line for _, line in DECLARED], turn % len(DECLARED))).alias("content"),
    )


def heredoc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as PHP files with one or two one-line heredocs and one over several lines."""
    doc = F.col("doc_id")
    filler = F.repeat(F.lit("x = 1\n"), (doc % 7).cast("int"))
    second = F.when(doc % 2 == 1, F.lit(ONE_LINE_HEREDOC + "\n")).otherwise("")
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        F.concat(F.lit("h/d"), doc.cast("string"), F.lit(".php")).alias("path"),
        F.concat(F.col("text"), F.lit(f"\n{ONE_LINE_HEREDOC}\n"), filler, second, filler, F.lit(HEREDOC)
                 ).alias("content"),
    )


def custom_rule_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as custom rule packs of one rule each: pack, json. Many leave optional fields out."""
    key = F.col("p_partkey")
    rule_id = (F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 1, pick(CUSTOM_RULE_IDS, key % 3))
               .otherwise(F.concat(F.lit("PART-"), (key % 500).cast("string"))))
    languages = F.array(*[F.lit(None) if names is None else F.array(*[F.lit(n) for n in names]).cast("array<string>")
                          for names in CUSTOM_LANGUAGES])
    rule = F.struct(
        rule_id.alias("id"),
        F.when(key % 4 != 0, F.col("p_name")).alias("name"),
        F.when(key % 3 == 0, F.lit("PARTS")).alias("category"),
        pick(CUSTOM_SEVERITIES, key % len(CUSTOM_SEVERITIES)).alias("severity"),
        F.get(languages, (key % len(CUSTOM_LANGUAGES)).cast("int")).alias("languages"),
        F.array("p_brand").alias("patterns"),
        F.when(key % 7 == 0, F.array("p_type")).alias("multi_line_patterns"),
    )
    return table(spark, sf_dir, "part").select(
        key.alias("pack"), F.to_json(F.struct(F.array(rule).alias("rules"))).alias("json"))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a name, whose language only their content tells: all ``pages``, a line added."""
    line = pick(PAGE_LINES, F.col("page_id") % len(PAGE_LINES))
    return texts(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id", F.lit("input").alias("path"), F.concat_ws("\n", "html", line).alias("content"))


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of manifests: manifest_id, slot (0-19), line; twenty parts make a manifest."""
    key, size = F.col("p_partkey"), F.col("p_size")
    slot = (key % 20).cast("int")
    manifest = F.expr("p_partkey div 20")
    npm = F.concat(F.lit('"'), pick(NPM_NAMES, slot), F.lit('": "'), pick(NPM_VERSIONS, size % 8), F.lit('"'))
    pypi = F.concat(pick(PYPI_NAMES, slot), pick(PYPI_SUFFIXES, size % 6))
    line = (F.when(manifest % 4 == 0, npm).when(manifest % 4 == 1, pypi)
            .when(manifest % 4 == 2, pick(GO_LINES, size % len(GO_LINES)))
            .otherwise(pick(CARGO_LINES, size % len(CARGO_LINES))))
    return table(spark, sf_dir, "part").select(
        manifest.alias("manifest_id"), slot.alias("slot"), line.alias("line"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest files made of the lines: manifest_id, path, content. A manifest has at most twenty lines."""
    rows = manifest_lines(spark, sf_dir).groupBy("manifest_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", "line"))).alias("rows"))

    def joined(keep, separator: str) -> Column:
        return F.array_join(F.transform(F.filter("rows", keep), lambda r: r["line"]), separator)

    everything = joined(lambda r: r["slot"] >= 0, "\n")
    npm = F.concat(F.lit('{"dependencies": {'), joined(lambda r: r["slot"] < 10, ", "),
                   F.lit('}, "devDependencies": {'), joined(lambda r: r["slot"] >= 10, ", "), F.lit("}}"))
    kind = F.col("manifest_id") % 4
    return rows.select(
        "manifest_id",
        F.concat(F.lit("m"), F.col("manifest_id").cast("string"), F.lit("/"), pick(MANIFEST_NAMES, kind)).alias("path"),
        F.when(kind == 0, npm).when(kind == 1, F.concat(F.lit("# header\n-r base.txt\n"), everything))
        .otherwise(everything).alias("content"),
    )


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as past scans, one per user and day."""
    def of(kind: str) -> Column:
        return F.count_if(F.col("event_type") == kind)

    user, day = F.col("user_id"), F.date_format("day", "yyyyMMdd")
    scans = (
        table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(of("error").alias("critical"), of("signup").alias("high"), of("purchase").alias("medium"),
             of("view").alias("low"), F.max("ts").alias("ts"))
    )
    penalty = 10 * F.col("critical") + 5 * F.col("high") + 2 * F.col("medium") + F.col("low")
    return scans.select(
        F.concat_ws("-", user.cast("string"), day).alias("id"),
        pick(SCAN_TYPES, user % 4).alias("scan_type"),
        F.concat(F.lit("user"), user.cast("string")).alias("source"),
        "ts",
        (F.col("critical") + F.col("high") + F.col("medium") + F.col("low")).alias("total"),
        "critical", "high", "medium", "low",
        score_of_penalty(penalty).alias("score"),
        grade(score_of_penalty(penalty)).alias("grade"),
    )
