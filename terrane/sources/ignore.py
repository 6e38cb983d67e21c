"""Which files of a source tree a scan leaves out: lists of names and endings, and ordered, negatable glob rules scoped by folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from terrane.functions.scratch import materialize

# Folders and files by name, endings, and parts of names of what is never a source.
FOLDERS = (
    ".git .svn .hg .bzr .idea .vscode .vs .eclipse .settings .DS_Store Thumbs.db node_modules bower_components jspm_packages vendor venv .venv env .env __pycache__ "
    ".pytest_cache .mypy_cache site-packages .tox eggs .eggs lib64 parts sdist wheels dist build out output bin obj target .next .nuxt .output .vercel .netlify "
    ".serverless _build public/build .parcel-cache .turbo .svelte-kit coverage .nyc_output htmlcov .coverage __tests__ __mocks__ .jest logs log tmp temp cache .cache "
    ".tmp .temp .generated generated auto-generated .terraform .husky .github .circleci .gitlab fixtures snapshots __snapshots__ testdata corpus corpora corpus_staging "
    "benchmarks benches artifacts datasets dataset"
).split()
FILES = (
    "package-lock.json yarn.lock pnpm-lock.yaml composer.lock Gemfile.lock poetry.lock Cargo.lock go.sum .gitignore .gitattributes .npmrc .yarnrc .editorconfig "
    ".prettierrc .prettierignore .eslintignore .dockerignore Thumbs.db .DS_Store LICENSE LICENSE.md LICENSE.txt CHANGELOG.md CHANGELOG CONTRIBUTING.md "
    "CODE_OF_CONDUCT.md SECURITY.md .env .env.local .env.development .env.production .env.test .env.example"
).split()
ENDINGS = (
    ".png .jpg .jpeg .gif .svg .ico .webp .bmp .tiff .tif .psd .ai .sketch .fig .xd .zip .tar .gz .rar .7z .bz2 .xz .tgz .exe .dll .so .dylib .a .lib .o .obj .class "
    ".jar .war .ear .pyc .pyo .pyd .beam .wasm .node .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .odp .mp4 .mp3 .wav .mov .avi .mkv .flv .wmv .ogg .webm .flac .aac "
    ".m4a .woff .woff2 .ttf .eot .otf .db .sqlite .sqlite3 .mdb .accdb .min.js .min.css .bundle.js .chunk.js .map .lock .pem .key .crt .cer .p12 .pfx .csv .tsv .parquet "
    ".avro .feather .npy .npz .pkl .pickle .h5 .hdf5 .bin .dat .data .raw .iso .img .dmg"
).split()
MARKS = (".bundle.", ".chunk.", ".generated.")


def never_source(path: Column) -> Column:
    """Whether a path has a folder or name of the lists, an ending (also of two parts) of theirs, or the name of something generated."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.element_at(parts, -1)
    low = F.lower(name)
    one, two = F.regexp_extract(low, r"(\.[^.]*)$", 1), F.regexp_extract(low, r"(\.[^.]*\.[^.]*)$", 1)
    some = F.arrays_overlap(parts, F.array(*map(F.lit, FOLDERS))) | name.isin(*FILES) | low.isin(*FILES) | one.isin(*ENDINGS) | two.isin(*ENDINGS) | low.endswith(".d.ts")
    for mark in MARKS:
        some = some | low.contains(mark)
    return some


def _class(body: str) -> str:
    """A bracket expression as a regular one; it never matches a slash."""
    negated = body[:1] in ("!", "^")
    return "(?!/)[" + "^" * negated + re.sub(r"([\[\]&^~\\])", r"\\\1", body[negated:]) + "]"


def glob_pattern(glob: str) -> str:
    """The regular expression (Java's or Python's) of a glob: ``*`` and ``?`` stay in a segment, ``**`` as a whole segment spans any number."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == len(glob) or glob[i + 2] == "/"):
            if i + 2 == len(glob):
                out += ".+" if i else ".*"
                i += 2
            else:
                out += "(?:.*/)?"
                i += 3
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))) > 0:
            out += _class(glob[i + 1 : end])
            i = end
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out += re.escape(c)
        i += 1
    return out


def parse_rule(line: str | None) -> tuple[bool, bool, str | None, str] | None:
    """Negated, for folders only, plain name (of a rule that is no more than one) and pattern of a line of an ignore file; None for blanks and comments."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", (line or "").rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    if not line:
        return None
    anchored = "/" in line
    if not anchored and not re.search(r"[*?\[\\]", line):
        return negated, folders, line, ""
    pattern = glob_pattern(line.lstrip("/") if line.startswith("/") else line)
    return negated, folders, None, pattern if anchored else f"(?:.*/)?{pattern}"


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``path`` of the files that the rules of ignore files leave out; ``files``: ``path``, ``rules``: ``folder`` (empty: the root), ``seq``, ``line``.

    As git has it: the last rule that matches decides, rules of deeper folders after those above; a rule without a slash but at its end matches names at
    any depth, others paths from their folder on; nothing below a folder that is left out can be taken in again. Every
    folder is decided once, however many files it has. Plain names, the commonest rules, are found by an equi-join; patterns by one on
    their folder. Null paths and lines match nothing; repeated rows come back once.
    """
    kind = "struct<negated:boolean,folders:boolean,name:string,pattern:string>"
    read = rules.select(F.coalesce("folder", F.lit("")).alias("folder"), "seq", F.udf(parse_rule, kind)("line").alias("r")).where("r IS NOT NULL").select("folder", "seq", "r.*")
    read = materialize(read, "ignore-rules")
    parts = F.split("path", "/")
    paths = files.select("path").where("path IS NOT NULL").distinct()
    steps = F.sequence(F.lit(1), F.size(parts))
    up = F.transform(steps, lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("item"), (n < F.size(parts)).alias("is_folder")))
    above = materialize(paths.select("path", F.inline(up)), "ignore-items")
    items = above.select("item", "is_folder").distinct()
    own = F.split("item", "/")
    scopes = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda n: F.struct(F.array_join(F.slice(own, 1, n), "/").alias("folder"), n.alias("depth")))
    at = items.select("item", "is_folder", F.element_at(own, -1).alias("name"), F.inline(scopes)).join(read.select("folder").distinct(), "folder", "left_semi")
    fits = ~F.col("folders") | F.col("is_folder")
    plain = at.join(read.where("name IS NOT NULL").drop("pattern"), ["folder", "name"]).where(fits)
    within = F.when(F.col("folder") == "", F.col("item")).otherwise(F.expr("substring(item, char_length(folder) + 2)"))
    globs = at.drop("name").join(read.where("name IS NULL").drop("name"), "folder").where(fits & F.rlike(within, F.concat(F.lit("^"), "pattern", F.lit("$"))))
    met = plain.select("item", "is_folder", "depth", "seq", "negated").union(globs.select("item", "is_folder", "depth", "seq", "negated"))
    last = met.groupBy("item", "is_folder").agg(F.max(F.struct("depth", "seq", "negated")).getField("negated").alias("negated"))
    return above.join(last.where("NOT negated"), ["item", "is_folder"], "left_semi").select("path").distinct()


def sources(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``files`` (``path``) that a scan takes: neither of the lists nor left out by ``rules``.

    Go commands stay: below ``cmd/name``, where a rule of the root is no more than that name, sources are not left out by rules.
    """
    bare = rules.where((F.coalesce("folder", F.lit("")) == "") & F.col("line").rlike(r"^\s*\\?[^!#\s/*?\[\]{}][^/*?\[\]{}]*/?\s*$")).select(F.regexp_replace(F.trim("line"), r"^\\|/$", "").alias("command")).distinct()
    gone = ignored_paths(files, rules)
    parts = F.split("path", "/")
    own = gone.where(F.col("path").startswith("cmd/") & ((F.size(parts) == 2) | F.col("path").endswith(".go"))).withColumn("command", F.get(parts, F.lit(1)))
    kept = own.join(bare, "command", "left_semi").select("path")
    return files.where(F.col("path").isNotNull() & ~never_source(F.col("path"))).join(gone.join(kept, "path", "left_anti"), "path", "left_anti")
