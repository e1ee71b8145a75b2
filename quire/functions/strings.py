"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.dates import Name, col

#: White space as trimming and collapsing see it: Unicode's, not ASCII's alone.
_SPACE = r"(?U)\s"


def u_trim(c: Name) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank(c: Name) -> Column:
    return col(c).isNull() | (u_trim(c) == "")


def contains_folded(c: Name, query: str) -> Column:
    """Case-insensitive LIKE '%query%'; % and _ in the query stay wildcards, as users of it rely on."""
    return col(c).ilike(f"%{query}%")


def snippet(content: Name, note: Name, limit: int = 160) -> Column:
    """The reader's note if it isn't blank, else the content, cut to limit with an ellipsis."""
    c = col(content)
    return F.when(~blank(note), col(note)).when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("…"))).otherwise(c)


def newlines(c: Name) -> Column:
    return F.regexp_replace(col(c), "\r\n?", "\n")


def file_name(c: Name) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def extension(c: Name) -> Column:
    """What follows the last dot, in lower case."""
    return F.lower(F.element_at(F.split(col(c), r"\."), -1))


def title_of_file(c: Name) -> Column:
    """What stands in 《》 in a file's name, else the name."""
    found = F.regexp_extract(col(c), "《([^》]+)", 1)
    return F.when(found != "", found).otherwise(col(c))


def author_of_file(c: Name) -> Column:
    """What follows 作者： in a file's name, else Unknown."""
    return F.when(col(c).contains("作者："), F.regexp_extract(col(c), "作者：(.*)", 1)).otherwise(F.lit("Unknown"))


def xml_escaped(c: Name) -> Column:
    out = col(c)
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def collapsed(c: Name) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(col(c), r"(?U)\s+", " ")


def context(text: Name, start: Name, end: Name, around: int = 120, limit: int = 600) -> Column:
    """The selection [start, end) with what stands around it, collapsed, trimmed and cut. Offsets are 0-based."""
    first = F.greatest(col(start) - around, F.lit(0))
    last = F.least(col(end) + around, F.length(col(text)))
    return F.substring(u_trim(collapsed(F.substring(col(text), (first + 1).cast("int"), (last - first).cast("int")))), 1, limit)


def safe_name(title: Name, length: int = 20) -> Column:
    """A file name from a title: its first characters, without those that file systems refuse."""
    cut = F.regexp_replace(F.substring(col(title), 1, length), r'[<>:"/\\|?*]', "_")
    return u_trim(F.regexp_replace(cut, r"[\n\r]", ""))


def title_or_file(title: Name, path: Name) -> Column:
    return F.when(blank(title) | (col(title) == "Unknown"), file_name(path)).otherwise(col(title))


def authors(names: Name) -> Column:
    """An array of names as one text, Unknown if there is none."""
    joined = F.concat_ws(", ", col(names))
    return F.when(joined == "", "Unknown").otherwise(joined)


def mapped(c: Name, source: str, target: str) -> Column:
    """Each character of source as the one of target at its first place: a script conversion, given both tables."""
    return F.translate(col(c), source, target)


def vertical_quotes(c: Name) -> Column:
    """Curly quotes as the corner brackets of vertical text."""
    return F.translate(col(c), "“”‘’", "『』「」")


def filled(template: Name, values: dict[str, Column]) -> Column:
    """A prompt template with double braces made single and then each {name} replaced."""
    out = F.replace(F.replace(col(template), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def reasoning(c: Name) -> Column:
    """The contents of all <think> elements."""
    return F.regexp_extract_all(col(c), F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))


def answer(c: Name) -> Column:
    """What stands outside <think> elements, trimmed."""
    return u_trim(F.regexp_replace(col(c), r"(?s)<think>.*?</think>", ""))


def tool_steps(c: Name) -> Column:
    """Tool steps of a reply: name, status and the decoded input and output of each self-closed <tool-step> tag, whose values are URL-encoded or base64 after b64:."""
    tags = F.regexp_extract_all(col(c), F.lit(r"(?s)<tool-step\s+([^>]*?)/>"), F.lit(1))

    def value(tag: Column, name: str) -> Column:
        raw = F.regexp_extract(tag, name + r'="([^"]*)"', 1)
        return F.when(raw == "", F.lit(None)).when(raw.startswith("b64:"), F.decode(F.unbase64(F.substring(raw, 5, 1 << 30)), "UTF-8")).otherwise(F.url_decode(raw))

    return F.transform(tags, lambda t: F.struct(*(value(t, n).alias(n) for n in ("name", "status", "input", "output"))))


def rgb(c: Name) -> Column:
    """Colour text (0x…, #… or hex digits) as a 24-bit number; null where it is none."""
    digits = F.regexp_replace(F.trim(col(c)), "^(0x|#)", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(digits, 16, 10).cast("long").bitwiseAND(0xFFFFFF))


def rgb_text(c: Name) -> Column:
    """A 24-bit number as 0x and six hex digits; null is 0."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.coalesce(col(c).cast("long"), F.lit(0)).bitwiseAND(0xFFFFFF))), 6, "0"))


def hash_rgb(c: Name) -> Column:
    """A colour from a text: h becomes 31 h + unit over its UTF-16 units, in 32 bits; the low 24 are the colour."""
    units = F.regexp_extract_all(F.hex(F.encode(col(c), "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    step = lambda h, u: (h * 31 + F.conv(u, 16, 10).cast("long")).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(units, F.lit(0).cast("long"), step).bitwiseAND(0xFFFFFF)


def dir_name(c: Name) -> Column:
    """A path up to and with its last slash."""
    return F.regexp_extract(col(c), "^(.*/)?", 1)


def resolved_path(path: Name, base: Name) -> Column:
    """A relative path seen from a base file's folder, with . and .. worked out; an absolute one without its first slash."""
    joined = F.when(col(path).startswith("/"), col(path)).otherwise(F.concat(dir_name(base), col(path)))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    push = lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), push), "/")


def relative_path(path: Name, base: Name) -> Column:
    """The path that leads from a base folder to a file."""
    a, b = (F.filter(F.split(col(x), "/"), lambda p: p != "") for x in (path, base))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), lambda i: (i <= F.size(b)) & (i <= F.size(a)) & (F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))))
    up = F.array_repeat(F.lit(".."), F.size(b) - shared)
    return F.array_join(F.concat(up, F.slice(a, shared + 1, F.size(a))), "/")


def uri_variables(template: Name) -> Column:
    """Names of a URI template's variables, without operators and modifiers."""
    groups = F.regexp_extract_all(col(template), F.lit(r"\{([^}]+)\}"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(F.regexp_replace(g, r"^[+#./;?&]", ""), ","), lambda v: F.regexp_replace(v, r"(\*|:\d+)$", ""))))


def uri_expanded(template: str, values: dict[str, Column]) -> Column:
    """A URI template with its variables' values: simple, reserved (+), fragment (#), label (.), path (/), parameter (;), query (?) and continuation (&) expansion of text values; null values are left out."""
    import re

    fixed = {"": ("", ",", False), "+": ("", ",", False), "#": ("#", ",", False), ".": (".", ".", False), "/": ("/", "/", False), ";": (";", ";", True), "?": ("?", "&", True), "&": ("&", "&", True)}
    out: list[Column] = []
    at = 0
    for m in re.finditer(r"\{([+#./;?&]?)([^}]+)\}", template):
        out.append(F.lit(template[at : m.start()]))
        at = m.end()
        first, between, named = fixed[m[1]]
        parts = []
        for spec in m[2].split(","):
            name, _, cut = spec.rstrip("*").partition(":")
            v = values.get(name, F.lit(None).cast("string"))
            v = F.substring(v, 1, int(cut)) if cut else v
            v = v if m[1] in ("+", "#") else F.replace(F.url_encode(v), F.lit("+"), F.lit("%20"))
            empty = "" if m[1] == ";" else "="
            parts.append(F.when(v.isNull(), F.lit(None)).when(v == "", F.lit(name + empty)).otherwise(F.concat(F.lit(name + "="), v)) if named else v)
        joined = F.concat_ws(between, *parts)
        out.append(F.when(F.coalesce(*parts).isNull(), "").otherwise(F.concat(F.lit(first), joined)))
    return F.concat(*out, F.lit(template[at:]))


def string_keys(nested: Column) -> Column:
    """A map of maps with the keys of both as text, as JSON has them."""
    return F.transform_values(F.transform_keys(nested, lambda k, v: k.cast("string")), lambda k, v: F.transform_keys(v, lambda a, b: a.cast("string")))
