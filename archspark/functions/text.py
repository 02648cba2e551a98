"""Text and path columns.

Patterns are Python's. In Java ``(?U)`` makes classes Unicode-aware and ``(?d)`` makes the
line feed the only line end, as they are in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V


def java(pattern: str, flags: str = "") -> str:
    return f"(?{flags}Ud){pattern}".replace("(?P<", "(?<")


def find_all(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """All matches' groups, in order; null where text is."""
    return F.regexp_extract_all(text, F.lit(java(pattern, flags)), F.lit(group))


def find(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """The first match's group, null without a match or where the group took no part."""
    return F.nullif(F.regexp_extract(text, java(pattern, flags), group), F.lit(""))


def has(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(java(pattern, flags))


def quoted(text: Column) -> Column:
    """text as a pattern that matches itself."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def let(value: Column, use) -> Column:
    """use(value), where value is computed once and its expression is not repeated in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def first_of(pairs: list[tuple[Column, Column | str]]) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(None).cast("string")
    for condition, value in reversed(pairs):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def any_of(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


# --- paths ------------------------------------------------------------------------


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """The extension in lower case, '' for names like ``.env``."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def language(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in V.LANGUAGES.items() for x in pair]), F.nullif(suffix(name), F.lit("")))


def component_id(path: Column) -> Column:
    return F.when(path == "", "root").otherwise(F.lower(F.replace(path, F.lit(" "), F.lit("-"))))


def ancestors(path: Column) -> Column:
    """Directories above path, the nearest last, the root ('') first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def folded(directory: Column, relative: Column) -> Column:
    """Where a relative import that starts in directory points to."""

    def step(at: Column, part: Column) -> Column:
        joined = F.when((at == "") | at.endswith("/"), F.concat(at, part)).otherwise(F.concat(at, F.lit("/"), part))
        return F.when(part == ".", at).when(part == "..", dirname(at)).otherwise(joined)

    return F.aggregate(F.split(relative, "/", -1), directory, step)


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_]", "")


def spaced(name: Column) -> Column:
    """A camel-case name in words."""
    return F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " ")


def titled(name: Column) -> Column:
    """Each letter after another character than a letter in upper case, all others in lower case."""
    chars = F.split(F.lower(name), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike("\\p{L}"), F.upper(c)).otherwise(c)), "")


# --- what files hold ----------------------------------------------------------------


def env_vars(content: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[find_all(content, p) for p in V.ENV_VARS])))


def ports(content: Column) -> Column:
    """Ports that a file listens on, ascending."""
    low, high = V.PORT_RANGE
    found = F.transform(F.concat(*[find_all(content, p, flags="m") for p in V.PORTS]), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: p.between(low, high))))


def _by_language(lang: Column, found: dict[str, Column], empty: Column) -> Column:
    out = empty
    for name, value in found.items():
        same = lang.isin("typescript", "javascript") if name == "typescript" else lang == name
        out = F.when(same, value).otherwise(out)
    return out


def imports(lang: Column, content: Column) -> Column:
    """Imported names: distinct and ascending, for Swift each in its order."""
    head = lambda x, sep: F.substring_index(x, sep, 1)

    def package(m: Column) -> Column:
        parts = F.split(m, "/", -1)
        scoped = parts[0].startswith("@") & (F.size(parts) > 1)
        return F.when(m.startswith("."), m).when(scoped, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])

    python = F.zip_with(find_all(content, V.IMPORTS["python"], 1, "m"), find_all(content, V.IMPORTS["python"], 2, "m"), lambda a, b: F.when(a != "", a).otherwise(b))
    ordered = lambda x: F.array_sort(F.array_distinct(x))
    return _by_language(
        lang,
        {
            "swift": find_all(content, V.IMPORTS["swift"], 1, "m"),
            "python": ordered(F.transform(F.filter(python, lambda m: m != ""), lambda m: head(m, "."))),
            "rust": ordered(F.filter(F.transform(find_all(content, V.IMPORTS["rust"], 1, "m"), lambda m: head(m, "::")), lambda m: ~m.isin(V.RUST_OWN_CRATES))),
            "typescript": ordered(F.concat(F.transform(find_all(content, V.IMPORTS["typescript"], 1, "m"), package), F.transform(find_all(content, V.IMPORTS["require"]), lambda m: head(m, "/")))),
            "go": ordered(F.transform(find_all(content, V.IMPORTS["go"]), basename)),
            "ruby": ordered(F.transform(F.concat(find_all(content, V.IMPORTS["ruby"]), find_all(content, V.IMPORTS["ruby_relative"])), lambda m: head(m, "/"))),
        },
        F.array().cast("array<string>"),
    )


def _lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n", -1), stripped)


def _only_conditional(content: Column, framework: str) -> Column:
    """Every ``import framework`` line stands between ``#if`` and ``#endif``."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("only"))

    def step(s: Column, line: Column) -> Column:
        depth = F.when(line.startswith("#if "), s["depth"] + 1).when(line == "#endif", F.greatest(F.lit(0), s["depth"] - 1)).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), (s["only"] & ~((line == f"import {framework}") & (s["depth"] == 0))).alias("only"))

    return F.aggregate(_lines(content), start, step)["only"]


def _only_optional(content: Column, module: str) -> Column:
    """Every import of module stands between ``try:`` and ``except``."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(True).alias("only"))

    def step(s: Column, line: Column) -> Column:
        leaves = line.startswith("except") & line.contains(":")
        imports_it = line.contains(f"import {module}") | line.contains(f"from {module}")
        plain = (line != "try:") & ~leaves & imports_it & ~s["inside"]
        return F.struct(F.when(line == "try:", True).when(leaves, False).otherwise(s["inside"]).alias("inside"), (s["only"] & ~plain).alias("only"))

    return F.aggregate(_lines(content), start, step)["only"]


def framework(lang: Column, content: Column) -> Column:
    quotes = lambda w: content.contains(f"'{w}") | content.contains(f'"{w}')
    swift = [
        (content.contains("import Vapor"), "Vapor"),
        (content.contains("import AppKit") & ~_only_conditional(content, "AppKit"), "AppKit"),
        (content.contains("import UIKit"), "UIKit"),
        (content.contains("import SwiftUI"), "SwiftUI"),
    ]
    python = [((content.contains(f"import {k}") | content.contains(f"from {k}")) & ~_only_optional(content, k), name) for k, name in V.FRAMEWORKS["python"]]
    go = [(content.contains(k), name) for k, name in V.FRAMEWORKS["go"]] + [(content.contains('"net/http"') & any_of(content, V.GO_SERVER_TOKENS), "net/http")]
    found = {
        "swift": first_of(swift),
        "python": first_of(python),
        "rust": first_of([(content.contains(k), name) for k, name in V.FRAMEWORKS["rust"]]),
        "typescript": first_of([(quotes(k), name) for k, name in V.FRAMEWORKS["typescript"]]),
        "go": first_of(go),
        "ruby": first_of([(content.contains(k), name) for k, name in V.FRAMEWORKS["ruby"]]),
    }
    return _by_language(lang, found, F.lit(None).cast("string"))


_ENDPOINT = "array<struct<method:string,path:string>>"


def _route(method: str | None = None, path: str | None = None):
    """Functions of one value for ``transform``, which passes an index to functions of two."""
    if path is not None:
        return lambda _: F.lit(path)
    return lambda p: F.struct(F.lit(method).alias("method"), p.alias("path"))


def _endpoints(content: Column, rules: list[tuple]) -> Column:
    out = []
    for pattern, method, path in rules:
        paths = find_all(content, pattern, path) if isinstance(path, int) else F.transform(find_all(content, pattern, method), _route(path=path))
        if isinstance(method, int):
            out.append(F.zip_with(find_all(content, pattern, method), paths, lambda m, p: F.struct(F.upper(m).alias("method"), p.alias("path"))))
        else:
            out.append(F.transform(paths, _route(method)))
    return F.concat(*out)


def _ruby_endpoints(content: Column) -> Column:
    """Each route twice: with the verb that its line has before it (else GET), and with its own.

    Routes and the text between them are found by one pass each; a fold over the pairs carries the line that is not ended yet.
    """
    pattern = V.ENDPOINTS["ruby"][0][0]
    found = F.struct(find_all(content, pattern, 0).alias("routes"), F.split(content, java(pattern), -1).alias("gaps"))
    start = F.struct(F.array().cast("array<string>").alias("verbs"), F.lit("").alias("line"))
    path = lambda route: F.regexp_extract(route, java(r"(?s)^[a-z]+\s+[\"'](.*)$"), 1)
    verb = lambda line: F.coalesce(first_of([(line.contains(v), v.upper()) for v in V.RUBY_VERBS_BEFORE]), F.lit("GET"))

    def step(s: Column, piece: Column) -> Column:
        before = F.substring_index(F.concat(s["line"], piece["gap"]), "\n", -1)
        return F.struct(F.concat(s["verbs"], F.array(verb(F.lower(before)))).alias("verbs"), F.substring_index(F.concat(before, piece["route"]), "\n", -1).alias("line"))

    def made(x: Column) -> Column:
        pieces = F.zip_with(x["routes"], F.slice(x["gaps"], 1, F.size(x["routes"])), lambda r, g: F.struct(g.alias("gap"), r.alias("route")))
        first = F.zip_with(F.aggregate(pieces, start, step)["verbs"], x["routes"], lambda v, r: F.struct(v.alias("method"), path(r).alias("path")))
        return F.concat(first, F.transform(x["routes"], lambda r: F.struct(F.upper(F.regexp_extract(r, "^[a-z]+", 0)).alias("method"), path(r).alias("path"))))

    return F.when(F.size(find_all(content, pattern, 0)) > 0, let(found, made)).otherwise(F.array().cast(_ENDPOINT))


def endpoints(lang: Column, content: Column) -> Column:
    found = {name: _ruby_endpoints(content) if name == "ruby" else _endpoints(content, rules) for name, rules in V.ENDPOINTS.items()}
    return _by_language(lang, found, F.array().cast(_ENDPOINT))


def framework_rank(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in V.FRAMEWORK_RANK.items() for x in pair]), name), F.when(name.isNotNull(), 1))


def http_client(lang: Column, content: Column) -> Column:
    out = F.lit(False)
    for name, patterns in V.HTTP_CLIENTS.items():
        out = F.when(lang == name, has(content, "|".join(f"(?:{p})" for p in patterns))).otherwise(out)
    return out


def urls(content: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(*[find_all(content, p, g) for p, g in V.URLS]), F.lower))


def referred_ports(content: Column) -> Column:
    """Numbers that stand where a file names a port."""
    plain = F.concat(*[find_all(content, p) for p in V.PORT_REFERENCES])
    in_urls = F.flatten(F.transform(find_all(content, V.QUOTED_URL, 0), lambda u: find_all(u, r":(\d+)\b")))
    return F.array_distinct(F.filter(F.transform(F.concat(plain, in_urls), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
