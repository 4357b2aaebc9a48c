"""Path functions: normalisation, kinds, components, layer roles, glob patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def _any(words: Iterable[str]) -> str:
    return "(" + "|".join(re.escape(w) for w in words) + ")"


def norm_path(path: Column) -> Column:
    """Trimmed path with forward slashes; null becomes empty."""
    return F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))


def norm_scope_path(path: Column) -> Column:
    """``norm_path`` without leading ``./`` and surrounding slashes; the dot of hidden names stays."""
    return F.regexp_replace(norm_path(path), r"^(\./|/)+|/+$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix_of(path: Column) -> Column:
    """Last suffix with its dot, lower case; empty for none, for hidden names and for a trailing dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem_of(name: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(name), r"^(.+)\.[^.]+$", "$1")


def plain_segments(path: Column) -> Column:
    """Lower-case path whose segments keep letters and digits only."""
    return F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}/]", "")


def has_parent(path: Column, words: Iterable[str]) -> Column:
    """A directory segment equals one of ``words``."""
    return path.rlike("(^|/)" + _any(words) + "/")


def is_hidden(path: Column) -> Column:
    """Some segment starts with a dot, other than ``.`` and ``..``."""
    return path.rlike(r"(^|/)\.(?!\.?(/|$))")


def is_test_path(path: Column) -> Column:
    plain = plain_segments(path)
    segments = [w for w in fixed.TEST_SEGMENTS if w.isalnum()]
    parent = plain.rlike(r"(^|/)([^/]*tests|[^/]*specs|" + _any(segments) + ")/")
    name = F.lower(file_name(path))
    endings = _any(fixed.TEST_NAME_ENDINGS)
    return parent | name.rlike(r"^(test_|spec_)") | name.rlike(endings + "$") | name.rlike(r"\.(test|spec)\.")


def is_doc_path(path: Column) -> Column:
    plain = plain_segments(path)
    stem = plain_segments(stem_of(path))
    return (
        has_parent(plain, fixed.DOC_SEGMENTS)
        | stem.rlike("^" + _any(fixed.DOC_NAMES))
        | suffix_of(path).isin(fixed.DOC_SUFFIXES)
    )


def is_generated_path(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.rlike(_any(fixed.GENERATED_ENDINGS) + "$") | name.rlike(_any(fixed.GENERATED_MARKERS))


def is_excluded_path(path: Column) -> Column:
    plain_words = [w for w in fixed.EXCLUDED_SEGMENTS if w.isalnum()]
    return (
        path.rlike(r"(?i)\.(egg-info|dist-info)\s*(/|$)")
        | has_parent(path, fixed.EXCLUDED_SEGMENTS)
        | has_parent(plain_segments(path), plain_words)
    )


def code_likeness(text: Column, first_lines: int | None = None, php_lines: int | None = None) -> Column:
    """True when the non-blank lines score 3 or more in one of three languages.

    ``first_lines`` looks at the first lines only (40 in an interactive scan); by default all count.
    ``php_lines`` looks for a PHP opening tag among the first lines only (8 in an interactive scan).
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n|\r"), lambda v: F.trim(v)), lambda s: s != "")
    if first_lines is not None:
        lines = F.slice(lines, 1, first_lines)

    def points(*rules: tuple[str, int]) -> Column:
        def line_points(line: Column) -> Column:
            total = F.lit(0)
            for pattern, value in rules:
                total = total + F.when(line.rlike(pattern), value).otherwise(0)
            return total

        return F.aggregate(lines, F.lit(0), lambda acc, line: acc + line_points(line))

    # Line patterns with their points, per language.
    python = points(
        (r"^(import |from |def |class |async def )", 2),
        (r"^(@|return |raise |yield )", 1),
        (r"^(if |elif |else:|for |while |with |try:|except |finally:|match |case )", 1),
        (r"__main__", 3),
    )
    script = points(
        (r"^(import |export |const |let |var |function )", 2), (r"=>|require\(|module\.exports", 1)
    )
    ruby = points((r"^(require |def |class |module )", 2), (r"^(end|begin)$|^attr_", 1))
    php = F.exists(lines if php_lines is None else F.slice(lines, 1, php_lines), lambda line: line.startswith("<?php"))
    return php | (python >= 3) | (script >= 3) | (ruby >= 3)


def shebang_source(text: Column) -> Column:
    """The first line names a known interpreter, directly or through env."""
    line = F.regexp_extract(text, r"^#!([^\r\n]*)", 1)
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    names = F.transform(words, lambda w: F.lower(F.substring_index(w, "/", -1)))
    is_env = F.coalesce(F.get(names, F.lit(0)), F.lit("")) == "env"
    rest = F.filter(F.slice(names, 2, 2**31 - 2), lambda w: ~w.startswith("-"))
    found = F.when(is_env, rest).otherwise(F.slice(names, 1, 1))
    return F.exists(found, lambda w: w.startswith("python") | w.isin(fixed.SHEBANG_NAMES))


def path_kind(path: Column, text: Column | None = None) -> Column:
    """Kind of a path, first match wins; ``text`` lets extensionless files be probed."""
    path = norm_path(path)
    name = F.lower(file_name(path))
    suffix = suffix_of(path)
    plain = plain_segments(path)
    if text is None:
        probed = F.lit("unsupported")
    else:
        readable = (F.length(text) > 0) & ~F.contains(text, F.lit("\0"))
        is_source = F.when(text.startswith("#!"), shebang_source(text)).otherwise(F.lit(False)) | code_likeness(text)
        # A shebang decides alone only when it names an interpreter; other scripts are scored.
        probed = F.when(F.coalesce(readable & is_source, F.lit(False)), "source").otherwise("unsupported")
    return (
        F.when(F.regexp_replace(path, "/", "") == "", "unknown")
        .when(path.rlike(r"(^|/)\."), "hidden")
        .when(is_excluded_path(path), "excluded")
        .when(is_doc_path(path), "doc")
        .when(has_parent(plain, fixed.FIXTURE_SEGMENTS), "fixture")
        .when(has_parent(plain, fixed.INFRA_SEGMENTS) | suffix.isin(".tf", ".hcl"), "infra")
        .when(is_generated_path(path), "generated")
        .when(is_test_path(path), "test")
        .when((suffix != "") & ~suffix.isin(fixed.CODE_SUFFIXES), "unsupported")
        .when((suffix != "") | name.isin(fixed.BARE_SOURCE_NAMES), "source")
        .otherwise(probed)
    )


def is_noise_path(path: Column) -> Column:
    """Hidden, excluded, doc, fixture, infra, generated or test path: the noise kinds of ``path_kind``, in few scans."""
    plain_words = [w for w in fixed.EXCLUDED_SEGMENTS + fixed.TEST_SEGMENTS if w.isalnum()]
    parents = plain_words + fixed.DOC_SEGMENTS + fixed.FIXTURE_SEGMENTS + fixed.INFRA_SEGMENTS
    raw = path.rlike(r"(^|/)\.|(^|/)" + _any(fixed.EXCLUDED_SEGMENTS) + "/")
    name = F.lower(path).rlike(
        r"\.(egg-info|dist-info)\s*(/|$)|"
        + _any(fixed.GENERATED_ENDINGS + fixed.TEST_NAME_ENDINGS)
        + "$|"
        + _any(fixed.GENERATED_MARKERS)
        + r"[^/]*$|(^|/)(test_|spec_)[^/]*$|\.(test|spec)\.[^/]*$|[^/]"
        + _any(fixed.DOC_SUFFIXES + [".tf", ".hcl"])
        + "$"
    )
    plain = plain_segments(path).rlike(r"(^|/)([^/]*tests|[^/]*specs|" + _any(parents) + ")/")
    return raw | name | plain | plain_segments(stem_of(path)).rlike("^" + _any(fixed.DOC_NAMES))


def cleanup_kind(path: Column, text: Column | None = None) -> Column:
    """Cleanup kind of a path (prompt, config, script, doc, source), null when out of scope."""
    path = norm_path(path)
    low = F.lower(path)
    name, suffix = F.lower(file_name(path)), suffix_of(path)
    kind = path_kind(path, text)
    prompt = (suffix == fixed.PROMPT_SUFFIX) | has_parent(low, fixed.PROMPT_DIRS)
    config = name.isin(fixed.CONFIG_NAMES) | suffix.isin(fixed.CONFIG_SUFFIXES)
    script = suffix.isin(fixed.SCRIPT_SUFFIXES) | (
        has_parent(low, fixed.SCRIPT_DIRS) & suffix.isin(fixed.SCRIPT_DIR_SUFFIXES)
    )
    dropped = kind.isin("unknown", "hidden", "excluded", "fixture", "generated", "infra", "test")
    return (
        F.when(dropped, F.lit(None).cast("string"))
        .when(prompt, "prompt")
        .when(config, "config")
        .when(script, "script")
        .when(kind.isin("doc", "source"), kind)
    )


def component_of(path: Column, prefix_rules: Sequence[tuple[str, str]] = ()) -> Column:
    """Component of a path: hidden, then prefix rules in order, then the generic layout rules.

    A rule is ``(prefix, component)``; ``{n}`` in the component stands for the
    stem of path segment n (0-based).
    """
    path = norm_path(path)
    parts = F.split(path, "/")

    def part(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    def stem(i: int) -> Column:
        return F.regexp_replace(F.trim(part(i)), r"^(.+)\.[^.]+$", "$1")

    out = F.when(is_hidden(path), "hidden")
    for prefix, component in prefix_rules:
        pieces = re.split(r"\{(\d+)\}", component)
        value = F.concat(*[stem(int(p)) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
        deepest = max([int(p) for p in pieces[1::2]], default=0)
        out = out.when(path.startswith(prefix) & (F.size(parts) > deepest), value)
    n = F.size(parts)
    return (
        out.when((n >= 2) & part(1).isin("tests", "test"), F.concat(part(0), F.lit(":tests")))
        .when((n >= 3) & part(1).isin("src", "lib", "app", "pkg"), F.concat(part(0), F.lit(":"), stem(2)))
        .when((n >= 4) & (part(1) == "packages"), F.concat(part(0), F.lit(":"), stem(2)))
        .when(n >= 2, F.concat(part(0), F.lit(":"), stem(1)))
        .otherwise(part(0))
    )


def layer_marker_flags(text: Column) -> list[tuple[str, Column]]:
    """(role, text holds one of the role's markers), in order of precedence."""
    return [(role, text.rlike("|".join(markers))) for role, markers in fixed.LAYER_MARKERS]


def layer_role(component: Column, files: Column) -> Column:
    """Role of a component from its name and file list (an array)."""
    text = F.lower(F.concat_ws(" ", component, files))
    out = F.when(component.endswith(":tests") | F.contains(text, F.lit("/tests/")), "tests")
    for role, flag in layer_marker_flags(text):
        out = out.when(flag, role)
    return out.otherwise("application_domain")


# --- patterns -----------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """Regex of a shell glob over a whole string; ``*`` crosses slashes, ``[!x]`` negates."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch in "*?":
            out.append(".*" if ch == "*" else ".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_regex_column(pattern: Column) -> Column:
    """``glob_regex`` of a pattern column, for rule tables that are DataFrames."""
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    negated = F.regexp_replace(escaped, r"\[!", "[^")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(negated, r"\*", ".*"), r"\?", "."), F.lit("$"))


def right_anchor_regex_column(pattern: Column) -> Column:
    """Regex of a right-anchored match: wildcards stay inside one segment, any directories may precede."""
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    negated = F.regexp_replace(escaped, r"\[!", "[^")
    inner = F.regexp_replace(F.regexp_replace(negated, r"\*+", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("(^|.*/)"), inner, F.lit("$"))


def has_wildcard(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]")


def path_matches(path: Column, pattern: Column) -> Column:
    """Equal, below the pattern as a directory, glob over the whole path, or right-anchored match."""
    bare = F.regexp_replace(pattern, "/+$", "")
    literal = (path == bare) | path.startswith(F.concat(bare, F.lit("/")))
    wild = F.rlike(path, glob_regex_column(pattern)) | F.rlike(path, right_anchor_regex_column(pattern))
    tail = F.concat(F.lit("/"), path).endswith(F.concat(F.lit("/"), bare))
    return F.when(bare == "", F.lit(False)).when(has_wildcard(pattern), literal | wild).otherwise(literal | tail)


def plan_path_matches(path: Column, pattern: Column) -> Column:
    """The plan variant: glob only when the pattern has a wildcard, else equal or below as a directory."""
    bare = F.regexp_replace(pattern, "/+$", "")
    literal = (path == bare) | path.startswith(F.concat(bare, F.lit("/")))
    wild = F.rlike(path, glob_regex_column(pattern)) | F.rlike(path, right_anchor_regex_column(pattern))
    return F.when(bare == "", F.lit(False)).when(has_wildcard(pattern), wild).otherwise(literal)


def module_matches(module: Column, pattern: Column) -> Column:
    """Glob when the pattern holds a wildcard, else equal or below it as a dotted prefix."""
    wild = F.rlike(module, glob_regex_column(pattern))
    literal = (module == pattern) | module.startswith(F.concat(pattern, F.lit(".")))
    return F.when((module == "") | (pattern == ""), F.lit(False)).when(has_wildcard(pattern), wild).otherwise(literal)
