"""Files as tables: listing, ignore rules, decoding, path aliases, nearest descriptors, changed files."""

from __future__ import annotations

import json
import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions that are scanned and the folders that never are.
MEDIA = tuple("png jpg jpeg svg gif webp mp4 webm mp3 wav".split())
EXTENSIONS = tuple("ts js tsx jsx json md py java go rs cpp cc cxx h hpp".split()) + MEDIA
ALWAYS_IGNORED = ("node_modules", "dist", ".git", ".turbo", "build")
SUFFIXES = (".ts", ".tsx", "/index.ts", "/index.tsx", ".js", ".jsx", "/index.js", "/index.jsx")


def extension(path: Column) -> Column:
    """The last extension without its dot; '' without one."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """``(negated, regex)`` over relative paths of one line of an ignore file; None for blanks and comments.

    A pattern with a slash before its end is tied to the root, others match at any depth;
    ``*`` and ``?`` stay within a folder, ``**`` does not; a match ignores all below it.
    """
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[negated:].removeprefix("\\")
    folder_only = p.endswith("/")
    p = p.rstrip("/")
    tied = "/" in p
    out, i = "", 0
    p = p.removeprefix("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return negated, ("^" if tied else "(?:^|/)") + out + ("/" if folder_only else "(?:/|$)")


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether a path is ignored: the last pattern that matches decides; the fixed folders always are."""
    out = F.lit(False)
    for p in patterns:
        if rule := ignore_regex(p):
            out = F.when(relative.rlike(rule[1]), F.lit(not rule[0])).otherwise(out)
    fixed = "(?:^|/)(?:" + "|".join(re.escape(x) for x in ALWAYS_IGNORED) + ")(?:/|$)"
    return out | relative.rlike(fixed)


def decode(content: Column) -> Column:
    """Text of a file's bytes by its byte-order mark, UTF-8 without one; marks and NULs are dropped."""
    head = F.hex(F.substring(content, 1, 3))
    text = (
        F.when(head.startswith("FFFE"), F.decode(content, "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(content, "UTF-16BE"))
        .otherwise(content.cast("string"))
    )
    return F.translate(F.regexp_replace(text, "^\ufeff", ""), "\0", "")


def scan_directory(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """``path, relative, size, mtime_ms, bytes`` of the files to scan below ``root``.

    ``patterns`` are the lines of the root's ignore files. The listing is the ``binaryFile``
    source, so bytes are only read by queries that use them. That source passes over names that
    begin with a dot or an underscore, and all below such folders; these are listed apart.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "/+$", "")
    base = "/" + root.removeprefix("file:").strip("/")
    rows = rows.select(
        path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), F.col("content").alias("bytes")
    )
    if hidden := hidden_files(spark, base):
        listed = spark.createDataFrame(hidden, "path string, size bigint, mtime_ms double")
        rows = rows.unionByName(listed.repartition(max(1, len(hidden) // 1000)).mapInArrow(_read_bytes, "path string, size bigint, mtime_ms double, bytes binary"))
    rows = rows.withColumn("relative", F.expr(f"substring(path, {len(base) + 2})"))
    return rows.where(extension(F.col("relative")).isin(*EXTENSIONS) & ~ignored(F.col("relative"), patterns or []))


def hidden_files(spark: SparkSession, root: str) -> list[tuple[str, int, float]]:
    """``(path, size, mtime_ms)`` of the files to scan below ``root`` (on a mounted file system) with a name or folder that begins with a dot or underscore."""
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in ALWAYS_IGNORED]
        inside = any(p[:1] in "._" for p in folder[len(root) :].split("/") if p)
        for n in names:
            if (inside or n[:1] in "._") and n.rpartition(".")[2] in EXTENSIONS:
                s = os.stat(os.path.join(folder, n))
                out.append((os.path.join(folder, n), s.st_size, float(int(s.st_mtime * 1000))))
    return out


def _read_bytes(batches):
    import pyarrow as pa

    for b in batches:
        data = []
        for p in b.column("path").to_pylist():
            with open(p, "rb") as f:
                data.append(f.read())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], [*b.schema.names, "bytes"])


def file_nodes(files: DataFrame) -> DataFrame:
    """``id, type, name, file, start_line, extension``: one node per file, media by extension."""
    ext = extension(F.col("path"))
    return files.select(
        F.col("path").alias("id"), F.when(F.lower(ext).isin(*MEDIA), "media").otherwise("file").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("path").alias("file"), F.lit(0).alias("start_line"), F.when(ext != "", F.concat(F.lit("."), ext)).alias("extension"),
    )


def changed_files(files: DataFrame, state: DataFrame, version: str = "1") -> DataFrame:
    """Files without an equal ``(path, size, mtime_ms, version)`` in ``state``: the ones to parse again."""
    old = state.where(F.col("version") == version).select("path", "size", "mtime_ms")
    return files.join(old, ["path", "size", "mtime_ms"], "left_anti")


def content_hash(text: Column, path: Column, version: str = "1", aliases: str = "") -> Column:
    """Key of a parse: version, text (Markdown without its front matter), relative path in lower case, and for scripts the aliases."""
    body = F.when(F.lower(path).rlike(r"\.mdx?$"), F.regexp_replace(text, r"(?s)^---\r?\n.*?\n---\r?\n", "")).otherwise(text)
    extra = F.when(F.lower(path).rlike(r"\.[cm]?[jt]sx?$"), F.lit(aliases)).otherwise(F.lit(""))
    return F.sha2(F.concat_ws("\x1f", F.lit(version), body, F.lower(path), extra), 256)


def strip_json_comments(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)


def read_config(configs: dict[str, str], path: str, seen: frozenset = frozenset()) -> dict:
    """A path config with what it extends merged in; the child wins, ``compilerOptions`` one level deeper. Bad text is an empty config."""
    if path in seen or path not in configs:
        return {}
    try:
        own = json.loads(strip_json_comments(configs[path]))
    except ValueError:
        return {}
    if not isinstance(own, dict):
        return {}
    out: dict = {}
    bases = own.get("extends") or []
    for base in bases if isinstance(bases, list) else [bases]:
        at = posixpath.normpath(posixpath.join(posixpath.dirname(path), base))
        at = at if at in configs else at + ".json"
        out = merge_config(out, read_config(configs, at, seen | {path}))
    return merge_config(out, own)


def merge_config(base: dict, child: dict) -> dict:
    out = {**base, **child}
    if isinstance(base.get("compilerOptions"), dict) and isinstance(child.get("compilerOptions"), dict):
        out["compilerOptions"] = {**base["compilerOptions"], **child["compilerOptions"]}
    return out


def alias_table(configs: dict[str, str]) -> list[tuple[str, str, int, str]]:
    """``(folder, prefix, position, target)`` of the path aliases of each config file, to be made a small table."""
    out = []
    for path in configs:
        options = read_config(configs, path).get("compilerOptions", {})
        folder = posixpath.dirname(path)
        base = posixpath.normpath(posixpath.join(folder, options.get("baseUrl", ".")))
        for key, targets in (options.get("paths") or {}).items():
            out += [(folder, key.removesuffix("*"), k, posixpath.normpath(posixpath.join(base, t.removesuffix("*"))) + "/" * t.endswith("/*")) for k, t in enumerate(targets)]
    return out


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest first."""
    parts = F.split(F.regexp_replace(path, "/[^/]*$", ""), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def nearest_descriptor(files: DataFrame, descriptors: DataFrame) -> DataFrame:
    """``path, descriptor``: for each file the descriptor (a table of ``path``) in its nearest folder upwards, if any.

    Ancestors meet folders of descriptors in an equi-join, and the deepest is a map-side maximum.
    """
    d = descriptors.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("path").alias("descriptor")).groupBy("folder").agg(F.min("descriptor").alias("descriptor"))
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    return up.join(d, "folder").groupBy("path").agg(F.max_by("descriptor", F.length("folder")).alias("descriptor"))


PROJECT_DEPTH = 4  # folders below the root in which descriptors of projects are sought
_PROJECT_NAME = {"go.mod": r"(?m)^\s*module\s+(\S+)", "Cargo.toml": r"(?s)\[package\].*?\bname\s*=\s*\"?([^\"\s]+)"}


def find_projects(spark: SparkSession, root: str, depth: int = PROJECT_DEPTH) -> DataFrame:
    """``kind, folder, name`` of the Go modules and Rust crates whose descriptor lies at most ``depth`` folders below ``root``; those without a name are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{go.mod,Cargo.toml}").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = rows.select(path.alias("path"), decode(F.col("content")).alias("text")).withColumn("kind", F.element_at(F.split("path", "/"), -1))
    base = "/" + root.removeprefix("file:").strip("/")
    inside = F.filter(F.split(F.expr(f"substring(path, {len(base) + 2})"), "/"), lambda x: x != "")
    shut = F.exists(inside, lambda x: x.startswith(".") | x.isin("node_modules", "target"))
    name = F.when(F.col("kind") == "go.mod", F.regexp_extract("text", _PROJECT_NAME["go.mod"], 1)).otherwise(F.regexp_extract("text", _PROJECT_NAME["Cargo.toml"], 1))
    return rows.where((F.size(inside) <= depth + 1) & ~shut).select("kind", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name")).where("name <> ''")


def java_source_folders(files: DataFrame, root: str, depth: int = PROJECT_DEPTH) -> DataFrame:
    """``folder``: ``src/main/java`` and ``src`` folders at most ``depth`` folders below ``root`` that hold files, and those of the root itself."""
    base = "/" + root.removeprefix("file:").strip("/")
    up = files.select(F.explode(ancestors(F.col("path"))).alias("folder")).distinct().where(F.col("folder").startswith(base))
    inside = F.filter(F.split(F.expr(f"substring(folder, {len(base) + 2})"), "/"), lambda x: x != "")
    own = F.when(F.col("folder").endswith("/src/main/java"), F.size(inside) - 3).when(F.col("folder").endswith("/src"), F.size(inside) - 1)
    shut = F.exists(inside, lambda x: x.startswith(".") | x.isin("node_modules", "build", "target"))
    found = up.where((own <= depth) & ~shut)
    fixed = files.sparkSession.createDataFrame([(f"{base}/src/main/java",), (f"{base}/src",), (base,)], "folder string")
    return found.unionByName(fixed).distinct()


def resolve_projects(imports: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """``file, specifier, resolved`` of the imports ``(file, specifier, lang)`` that name a part of a found Go module or Rust crate.

    The longest module name that begins a Go import decides; what follows is a folder of it, for
    which its least file stands. A Rust path that begins with a crate's name means the file of its
    longest part below the crate's ``src``. Prefixes meet names in an equi-join.
    """
    rows = imports.where(F.col("lang").isin("go", "rs")).withColumn("parts", F.split(F.col("specifier"), F.when(F.col("lang") == "go", F.lit("/")).otherwise(F.lit("::"))))
    rows = rows.select("file", "specifier", "lang", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    rows = rows.withColumn("name", F.array_join(F.slice("parts", 1, F.col("n")), "/")).where((F.col("lang") == "go") | (F.col("n") == 1))
    p = projects.select(F.when(F.col("kind") == "go.mod", "go").otherwise("rs").alias("lang"), "folder", "name")
    met = rows.join(p, ["lang", "name"]).withColumn("rest", F.expr("slice(parts, n + 1, size(parts))"))
    go = met.where("lang = 'go'").select("file", "specifier", "n", F.concat_ws("/", F.col("folder"), F.array_join("rest", "/")).alias("at")).withColumn("at", F.regexp_replace("at", "/$", ""))
    folders = files.where(F.col("path").endswith(".go")).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("at")).agg(F.min("path").alias("path"))
    go = go.join(folders, "at").groupBy("file", "specifier").agg(F.max_by("path", "n").alias("resolved"))
    rs = met.where("lang = 'rs'").withColumn("k", F.explode(F.sequence(F.size("rest"), F.lit(0), F.lit(-1))))
    stem = F.concat_ws("/", F.col("folder"), F.lit("src"), F.when(F.col("k") > 0, F.array_join(F.expr("slice(rest, 1, k)"), "/")))
    ends = F.when(F.col("k") > 0, F.array(F.concat("stem", F.lit(".rs")), F.concat("stem", F.lit("/mod.rs")))).otherwise(F.array(F.concat("stem", F.lit("/lib.rs")), F.concat("stem", F.lit("/main.rs"))))
    rs = rs.withColumn("stem", stem).select("file", "specifier", "k", F.posexplode(ends).alias("e", "path")).join(files.select("path").distinct(), "path")
    rs = rs.groupBy("file", "specifier").agg(F.min_by("path", F.struct((-F.col("k")).alias("k"), "e")).alias("resolved"))
    return go.unionByName(rs).where("resolved <> file")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """``file, specifier, resolved``: script imports to scanned files.

    Relative specifiers resolve against the importing file. Others try the aliases of the
    nearest folder that has some, longest prefix first, each target in order. A path stands for
    the first existing of itself with eight endings; ``.js`` at its end is dropped first.
    Specifiers that resolve to nothing have no row. ``aliases(folder, prefix, position, target)``
    is joined on folder and prefix, not compared with every import.
    """
    spec = F.regexp_replace("specifier", r"\.js$", "")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    rel = imports.where(F.col("specifier").rlike(r"^\.{1,2}(/|$)")).select("file", "specifier", F.lit(0).alias("near"), F.lit(0).alias("len"), F.lit(0).alias("position"), F.concat(folder, F.lit("/"), spec).alias("base"))
    bare = imports.where(~F.col("specifier").rlike(r"^\.{1,2}(/|$)")).select("file", "specifier", spec.alias("s"), F.posexplode(ancestors(F.col("file"))).alias("near", "folder"))
    cut = F.explode(F.sequence(F.lit(0), F.length("s")))
    bare = bare.join(aliases.select("folder").distinct(), "folder", "left_semi")
    near = bare.groupBy("file", "specifier", "s").agg(F.min_by("folder", "near").alias("folder"))
    bare = near.withColumn("n", cut).withColumn("prefix", F.expr("substring(s, 1, n)"))
    ali = bare.join(aliases, ["folder", "prefix"]).select("file", "specifier", F.lit(0).alias("near"), (-F.length("prefix")).alias("len"), "position", F.concat("target", F.expr("substring(s, n + 1)")).alias("base"))
    tries = rel.unionByName(ali).withColumn("base", _normal(F.col("base")))
    tries = tries.select("*", F.posexplode(F.array(*[F.lit(x) for x in SUFFIXES])).alias("k", "end")).withColumn("path", F.concat("base", "end"))
    hit = tries.join(files.select("path").distinct(), "path")
    return hit.groupBy("file", "specifier").agg(F.min_by("path", F.struct("near", "len", "position", "k")).alias("resolved"))


def _normal(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def module_endings(specifier: Column, lang: Column) -> Column:
    """Path endings, best first, that a module name of a language other than script can stand for; none for what is surely elsewhere."""
    s = F.trim(specifier)
    py = F.replace(F.regexp_replace(s, r"^\.+", ""), F.lit("."), F.lit("/"))
    java = F.replace(F.regexp_replace(s, r"\.\*$", ""), F.lit("."), F.lit("/"))
    above = F.regexp_replace(java, "/[^/]*$", "")
    parts = F.filter(F.split(s, "::"), lambda x: ~x.isin("crate", "self", "super", ""))
    heads = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rs = F.flatten(F.transform(heads, lambda h: F.array(F.concat(h, F.lit(".rs")), F.concat(h, F.lit("/mod.rs")))))
    return (
        F.when((lang == "py") & (py != ""), F.array(F.concat(py, F.lit(".py")), F.concat(py, F.lit("/__init__.py"))))
        .when(lang == "java", F.when(java.contains("/"), F.array(F.concat(java, F.lit(".java")), F.concat(above, F.lit(".java")))).otherwise(F.array(F.concat(java, F.lit(".java")))))
        .when((lang == "rs") & (F.size(parts) > 0), rs)
        .when(lang == "cpp", F.array(s))
    )


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``file, specifier, resolved`` for imports ``(file, specifier, lang)`` of Python, Java, Rust and C++ files.

    A module stands for a scanned file whose path ends with one of its candidate endings; the
    first ending that any file has wins, then the file that shares most leading folders with the
    importing one, then the least path. Endings meet the files' own endings in an equi-join, so
    no import is compared with every file. Go packages name folders: the least file of the
    folder whose path ends with the package's last two parts stands for it.
    """
    distinct = imports.where("specifier is not null").select("specifier", "lang").distinct()
    keys = distinct.where("lang <> 'go'").select("specifier", "lang", F.posexplode(module_endings(F.col("specifier"), F.col("lang"))).alias("k", "ending"))
    go = distinct.where("lang = 'go'").withColumn("p", F.split("specifier", "/"))
    go = go.select("specifier", "lang", F.lit(0).alias("k"), F.array_join(F.slice("p", F.greatest(F.size("p") - 1, F.lit(1)), 2), "/").alias("ending"))
    parts = F.split("path", "/")
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/")))
    whole = files.select("path", tails.alias("ending"))
    folder = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    goes = files.where(F.col("path").endswith(".go")).select("path", F.explode(F.array_distinct(F.array(F.element_at(folder, -1), F.array_join(F.slice(folder, F.greatest(F.size(folder) - 1, F.lit(1)), 2), "/")))).alias("ending"))
    hits = keys.join(whole, "ending").unionByName(go.join(goes, "ending"))
    hits = imports.select("file", "specifier", "lang").distinct().join(hits, ["specifier", "lang"]).where("path <> file")
    a, b = F.split("file", "/"), F.split("path", "/")
    common = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)), lambda x: x))
    return hits.groupBy("file", "specifier").agg(F.min_by("path", F.struct("k", (-common).alias("c"), "path")).alias("resolved"))


def base_package(id_: Column, path: Column) -> Column:
    """``import::<package>`` for the import of a package's part by a script: scoped names keep two segments, others one; other ids stay."""
    spec = F.regexp_replace(id_, "^import::", "")
    script = F.lower(path).rlike(r"\.[cm]?[jt]sx?$") & id_.startswith("import::") & ~id_.contains("import::.") & ~spec.contains("::")
    return F.when(script, F.concat(F.lit("import::"), F.regexp_extract(spec, r"^(?:node:)?(@[^/]+/[^/]+|[^/]*)", 1))).otherwise(id_)


def link_imports(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges ``(path, source, target, ...)`` of parsed files with the module part of each target replaced by the file it resolves to.

    ``import::<module>`` becomes the file, ``<module>::name`` (with or without ``import::``) the symbol in it; others stay.
    What a package was said to define goes if it is a file's after all: the file says so itself.
    """
    bare = F.regexp_replace("target", "^import::", "")
    cut = F.when(F.col("type") == "imports", F.lit(0)).otherwise(F.length(bare) - F.length(F.element_at(F.split(bare, "::"), -1)) - 2)
    module = F.when(cut > 0, F.substring(bare, F.lit(1), cut)).otherwise(bare)
    name = F.when(cut > 0, F.concat(F.lit("::"), F.element_at(F.split(bare, "::"), -1))).otherwise(F.lit(""))
    rows = edges.withColumns({"_m": module, "_n": name})
    r = resolved.select(F.col("file").alias("path"), F.col("specifier").alias("_m"), "resolved")
    out = rows.join(r, ["path", "_m"], "left").where(F.col("resolved").isNull() | ~F.col("source").startswith("import::")).withColumn("target", F.coalesce(F.concat("resolved", "_n"), "target"))
    return out.select(*edges.columns).where("source <> target")
