"""Scalar rules as Column expressions. All stay inside the JVM; regular expressions use explicit classes.

Regular expressions and word lists that decide results are fixed values, stated in FIXED below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
HUMP = r"[A-Z][a-z0-9]*"
BOILERPLATE_NAMES = ("equals", "hashCode", "toString")
ACCESSOR = r"\b(get|set|is)[A-Z0-9_]"
GETTER_BODY = r"(?s)\)\s*(?:throws [\w., ]+)?\{\s*return\s+[\w.]+\s*;\s*\}\s*$"
EMBED_CHARS = 8000
PRESSURE = 0.8
CHARS_PER_TOKEN = 4
SLUG_CHARS = 60


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """White space off both ends, all that Unicode knows and the information separators."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f\x{85}]+|[\s\x1c-\x1f\x{85}]+$", "")


def clean_text(x) -> Column:
    """Runs of blanks (space, tab, no-break space) to one space, three line ends or more to two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(_c(x), r"[ \t\x{00A0}]+", " "), r"\n{3,}", "\n\n"))


def identifiers(x) -> Column:
    """All identifiers of a text, in order."""
    return F.regexp_extract_all(_c(x), F.lit(f"({IDENTIFIER})"), F.lit(1))


def is_linkable(symbol) -> Column:
    """True for a name of several humps that prose wouldn't use as a word; false for null."""
    s = F.coalesce(_c(symbol), F.lit(""))
    return s.rlike("^[A-Z]") & s.rlike("[a-z]") & (F.size(F.regexp_extract_all(s, F.lit(f"({HUMP})"), F.lit(1))) >= 2)


def find_mentions(text, symbols) -> Column:
    """Sorted distinct identifiers of text that are in the array `symbols`."""
    return F.array_sort(F.array_intersect(identifiers(text), _c(symbols)))


def simple_name(x) -> Column:
    """What follows the last point."""
    return F.regexp_replace(_c(x), r"^.*\.", "")


def type_symbol(x) -> Column:
    """What precedes the first point."""
    return F.split_part(_c(x), F.lit("."), F.lit(1))


def owner(x) -> Column:
    """What precedes the last point, or all."""
    return F.regexp_replace(_c(x), r"\.[^.]*$", "")


def top_area(path) -> Column:
    return F.split_part(_c(path), F.lit("/"), F.lit(1))


def content_hash(x) -> Column:
    return F.sha2(_c(x), 256)


def fragment_id(repo, path, kind, symbol) -> Column:
    return F.xxhash64(_c(repo), _c(path), _c(kind), _c(symbol))


def parent_dir(path) -> Column:
    """The POSIX parent, "" at the top; null above the root."""
    p = _c(path)
    return F.when(p == "", F.lit(None)).otherwise(F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("")))


def ancestors(directory) -> Column:
    """The directory and all above it, with "" first."""
    d = _c(directory)
    parts = F.split(d, "/")
    down = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(d == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), down))


def depth(directory) -> Column:
    d = _c(directory)
    return F.when(d == "", F.lit(0)).otherwise(F.size(F.split(d, "/")))


def dir_kind(directory, is_module) -> Column:
    return F.when(_c(directory) == "", "project").when(_c(is_module), "module").otherwise("directory")


def is_ctor(method_symbol, class_symbol) -> Column:
    return simple_name(method_symbol) == simple_name(class_symbol)


def is_boilerplate(method_symbol, signature, content, compat: bool = False) -> Column:
    """Accessors, single-return getters and the inherited three. compat looks for accessor names in the whole signature, not in the method's name."""
    name = simple_name(method_symbol)
    accessor = _c(signature).rlike(ACCESSOR) if compat else name.rlike("^(get|set|is)[A-Z0-9_]")
    return name.isin(*BOILERPLATE_NAMES) | F.coalesce(accessor, F.lit(False)) | F.coalesce(_c(content).rlike(GETTER_BODY), F.lit(False))


def is_record(signature) -> Column:
    return F.instr(F.concat(F.lit(" "), F.coalesce(_c(signature), F.lit("")), F.lit(" ")), " record ") > 0


def facts_key(model, bodies, class_signature, facts) -> Column:
    """What a note depends on: model, mode, class header and the array `facts`, which is sorted here."""
    head = [F.concat(F.lit("model="), _c(model)), F.concat(F.lit("bodies="), _c(bodies)), _c(class_signature)]
    return F.concat_ws("\n", *head, F.array_sort(_c(facts)))


def inputs_digest(model, children) -> Column:
    """SHA-256 over the model and the lines of an array of structs (kind, name, body), sorted by kind and name."""
    lines = F.transform(F.array_sort(_c(children)), lambda c: F.concat_ws("\t", c["kind"], c["name"], c["body"]))
    return F.sha2(F.concat_ws("\n", F.concat(F.lit("model="), _c(model)), lines), 256)


def embed_input(x, limit: int = EMBED_CHARS) -> Column:
    """What an embedder is given: stripped, at most `limit` characters, a word for what is empty."""
    s = strip(F.coalesce(_c(x), F.lit("")))
    return F.when(s == "", F.lit("(empty)")).otherwise(F.substring(s, 1, limit))


def strip_think(x) -> Column:
    return F.regexp_replace(_c(x), r"(?s)<think>.*?</think>\s*", "")


def strip_directive(x) -> Column:
    return F.regexp_replace(_c(x), r"\s*/no_think\s*$", "")


def context_fill(chars, window) -> Column:
    return F.round(_c(chars) / CHARS_PER_TOKEN / _c(window), 2)


def under_pressure(chars, window) -> Column:
    return _c(chars) / CHARS_PER_TOKEN >= PRESSURE * _c(window)


def heading_of(signature, symbol) -> Column:
    return F.coalesce(F.nullif(_c(signature), F.lit("")), _c(symbol))


def section_symbol(path, part, parts) -> Column:
    base = F.when(F.size(_c(path)) > 0, F.array_join(_c(path), " / ")).otherwise(F.lit("(untitled)"))
    return F.when(_c(parts) > 1, F.concat(base, F.lit(" ["), _c(part).cast("string"), F.lit("/"), _c(parts).cast("string"), F.lit("]"))).otherwise(base)


def slug(page_id, title) -> Column:
    """A file name stem: id, then the title in lower-case letters and digits joined by hyphens."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(title), F.lit(""))), "[^a-z0-9]+", "-")
    trim = lambda x: F.regexp_replace(x, "^-+|-+$", "")
    s = trim(F.substring(trim(s), 1, SLUG_CHARS))
    return F.when(s == "", _c(page_id).cast("string")).otherwise(F.concat_ws("-", _c(page_id).cast("string"), s))


def wiki_page(title, body) -> Column:
    return F.concat(F.lit("<html><body><h1>"), _c(title), F.lit("</h1>\n"), _c(body), F.lit("</body></html>\n"))


def leaf_markdown(symbol, path, line_start, signature, body) -> Column:
    c = F.concat
    return c(F.lit("# "), _c(symbol), F.lit("\n\n- **file:** "), _c(path), F.lit(":"), _c(line_start).cast("string"), F.lit("\n- **signature:** `"), _c(signature), F.lit("`\n- **kind:** llm-note (leaf/class)\n\n"), _c(body), F.lit("\n"))


def rollup_markdown(directory, kind, body) -> Column:
    d = _c(directory)
    return F.concat(F.lit("# "), F.when(d == "", "(project root)").otherwise(d), F.lit("\n\n- **kind:** llm-note ("), _c(kind), F.lit(" rollup)\n- **path:** "), F.when(d == "", ".").otherwise(d), F.lit("\n\n"), _c(body), F.lit("\n"))


def cosine_distance(a, b) -> Column:
    """1 - cosine of two vectors, in doubles; null where lengths differ or a vector is zero."""
    a, b = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
    product = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (product > 0), 1 - dot / product)
