"""Predicates and classifications as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Extensions by kind, and size limits in bytes by kind.
KINDS = {"markdown": ("md", "markdown", "mdx"), "text": ("txt", "text", "rst"), "docx": ("docx",), "pdf": ("pdf",)}
LIMITS = {"markdown": 20 << 20, "text": 20 << 20, "docx": 16 << 20, "pdf": 8 << 20}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    e = extension(path)
    return reduce(lambda w, k: w.when(e.isin(*KINDS[k]), k), list(KINDS)[1:], F.when(e.isin(*KINDS["markdown"]), "markdown"))


def within_limit(path: Column, size: Column) -> Column:
    k = kind(path)
    return F.coalesce(reduce(lambda a, b: a | b, [(k == n) & (size <= m) for n, m in LIMITS.items()]), F.lit(False))


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]), i + 1
    return f"^{out}$"


def ignored(path: Column, globs: list[str]) -> Column:
    """One regular expression for all globs."""
    return path.rlike("|".join(glob_regex(g) for g in globs))


# Folders that are never indexed.
DEFAULT_IGNORED = [f"**/{name}/**" for name in (".git", "node_modules", "vendor", "Pods", "target", "dist", "build", "out", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", "coverage", ".venv", "venv")]


def skipped(path: Column, root: Column, globs: list[str] | None = None) -> Column:
    """Whether a path below ``root`` matches a default or given glob; globs are held against the part after the root."""
    return F.coalesce(ignored(F.substr(path, F.length(root) + 2), DEFAULT_IGNORED + list(globs or [])), F.lit(False))


def within_roots(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or below one; a mere common beginning of names does not count."""
    return reduce(lambda a, b: a | b, [under(path, F.lit(r.rstrip("/"))) for r in roots], F.lit(False))


def under(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def low_information(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    headings = (F.size(lines) > 0) & F.forall(lines, lambda x: F.startswith(x, F.lit("#"))) & (visible <= 24)
    coded = (F.size(lines) >= 2) & F.forall(lines, lambda x: (F.octet_length(x) >= 24) & x.rlike("^[A-Za-z0-9+/=]+$"))
    return (F.trim(F.regexp_replace(text, r"\s+", " ")) == "") | headings | coded


def file_ready(q: Column) -> Column:
    return (F.regexp_count(q, F.lit(r"[^\x00-\x7F&&\p{L}]")) >= 1) | (F.regexp_count(q, F.lit("[A-Za-z]")) >= 2)


def kill_ready(q: Column) -> Column:
    return ~F.startswith(q, F.lit("pid:")) & ((F.regexp_count(q, F.lit("[0-9]")) >= 2) | file_ready(q))


def action_intent(q: Column) -> Column:
    return F.startswith(q, F.lit("/")) | F.startswith(q, F.lit("http")) | F.contains(q, F.lit("{"))


def mode(q: Column) -> Column:
    return F.when(q.rlike(r"(^|\s)@\S*$"), "file").when(F.trim(q) == "", "none").when(F.startswith(q, F.lit("kill ")), "kill").when(action_intent(q), "action").when(file_ready(q), "app").otherwise("none")


# Code points by script; CJK is looked for first.
SCRIPTS = {
    "cjk": r"\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{31A0}-\x{31BF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7AF}\x{D7B0}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}",
    "latin": r"\x{0041}-\x{024F}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}\x{A720}-\x{A7FF}\x{AB30}-\x{AB6F}",
    "greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "cyrillic": r"\x{0400}-\x{052F}\x{1C80}-\x{1C8F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
    "hebrew": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0870}-\x{089F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
}


def characters(text: Column, kind: str) -> Column:
    """How many characters of a class a text has; runs of them are taken out, as each match by itself would become a string."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def once(values: dict[str, Column], make) -> Column:
    """``make(struct of values)``, for which each value is worked out once, however often it is named."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), make), 0)


def script_counts(text: Column) -> dict[str, Column]:
    """How many letters of each script a text has; letters of none of them are other."""
    n = {k: characters(text, f"[{v}]") for k, v in SCRIPTS.items()}
    return n | {"other": characters(text, r"[\p{IsAlphabetic}&&[^" + "".join(SCRIPTS.values()) + "]]")}


def mixed_scripts(text: Column) -> Column:
    """CJK beside much of other letters or of two more scripts, which decoding faults give."""
    return once(script_counts(text), lambda x: mixed({k: x[k] for k in (*SCRIPTS, "other")}))


def mixed(n: dict[str, Column]) -> Column:
    """The same of counted letters."""
    total = reduce(lambda a, b: a + b, n.values())
    much = {k: (v >= 6) & (v * 100 >= total * 12) for k, v in n.items()}
    named = reduce(lambda a, b: a + b, [much[k].cast("int") for k in ("cyrillic", "arabic", "hebrew", "greek")])
    return much["cjk"] & (much["other"] | (named >= 2))


def readable(text: Column) -> Column:
    """Page gate: enough word characters, few suspicious ones, no mix of scripts."""
    n = script_counts(text) | {
        "visible": F.length(F.regexp_replace(text, r"\s+", "")),
        "word": characters(text, r"[\p{L}\p{N}]"),
        "odd": characters(text, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FFF0}-\x{FFFF}\x{E000}-\x{F8FF}\p{Cc}&&[^\s]]"),
    }
    few = lambda x: (x["word"] >= 1) & (x["odd"] == 0)
    many = lambda x: (x["word"] * 100 >= x["visible"] * 45) & (x["odd"] * 100 <= x["visible"] * 10) & ~mixed({k: x[k] for k in (*SCRIPTS, "other")})
    return once(n, lambda x: F.when(x["visible"] < 24, few(x)).otherwise(many(x)))


def target(s: Column) -> Column:
    t = F.trim(s)
    return (
        F.when(t.rlike(r"^[A-Za-z]:[\\/]"), "path")
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "url")
        .when(t.rlike(r"^(/|~/|\.{1,2}/)"), "path")
        .when(t.rlike(r"^(?i)(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}(/\S*)?$"), "url")
        .otherwise("unknown")
    )


def failure_class(message: Column) -> Column:
    m = F.lower(message)
    return F.when(F.contains(m, F.lit("timeout")) | F.contains(m, F.lit("timed out")), "timeout").when(F.contains(m, F.lit("429")) | F.contains(m, F.lit("rate limit")), "rate_limit").when(F.contains(m, F.lit("overload")) | F.contains(m, F.lit("503")), "overloaded").otherwise("other")


def event_plan(kind: Column, paths: Column, folder: Column | None = None) -> Column:
    """What a watcher's event asks for: nothing, a scan of all, a walk of a new folder, a delete, or a look at its paths.

    Reads and changes of metadata alone ask for nothing; events of unknown kind, and others that name no path, for a
    scan. ``folder`` says whether the path is a folder that is there: only its renaming asks for a scan, its
    creation for a walk of what it holds; other events of it tell nothing.
    """
    folder = F.coalesce(folder, F.lit(False)) if folder is not None else F.lit(False)
    known = F.coalesce(kind.isin("create", "modify", "rename", "remove", "other"), F.lit(False))
    return (
        F.when(kind.isin("access", "metadata"), "ignore")
        .when(~known | (F.size(paths) == 0), "rescan")
        .when(folder, F.when(kind == "rename", "rescan").when(kind == "create", "walk").otherwise("ignore"))
        .when(kind == "remove", "delete")
        .otherwise("path")
    )
