"""Tokenisers, role tokens, intent and changelog predicates, symbol ranks and variant families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..common import string_array
from .paths import file_name, norm_path


def all_name_tokens(text: Column) -> Column:
    """Lower-case words of an identifier or path, split at case changes and punctuation, repeats kept."""
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def name_tokens(text: Column) -> Column:
    """Distinct words of an identifier without stop words."""
    return F.array_distinct(F.array_except(all_name_tokens(text), string_array(fixed.NAME_STOPWORDS)))


def path_tokens(path: Column) -> Column:
    """Distinct lower-case alphanumeric runs of a path."""
    return F.array_distinct(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda t: t != ""))


def symbol_tokens(symbol: Column) -> Column:
    """Words of the last dotted part of a symbol."""
    return all_name_tokens(F.substring_index(symbol, ".", -1))


# Words that carry no meaning in a goal or question.
GOAL_STOPWORDS = """
the a an for and or to of in on with by is are be as this that it from at into new feature please add
implement support current project review analyze analysis improve improvement architecture system
stability stable 优化 实现 功能 建议 需要 新增 问题 如何 一个 进行 当前 项目 代码 分析 架构 稳定
""".split()
GOAL_TOKEN_LIMIT = 80
WORD = "[A-Za-z_][A-Za-z0-9_./-]+"


def goal_tokens(text: Column, limit: int | None = None) -> Column:
    """Distinct words of a goal: 3 or more characters, no stop words; ``limit`` keeps the first such words only."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)
    kept = F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(GOAL_STOPWORDS))
    return F.array_distinct(kept if limit is None else F.slice(kept, 1, limit))


def document_tokens(text: Column) -> Column:
    """Distinct lower-case words of a document; slashes, dashes and dots separate."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "/-.", "   ")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))


def component_tokens(component: Column, limit: int | None = None) -> Column:
    """Words of a component name that a goal may mention; ``limit`` keeps the first such words only."""
    low = F.translate(F.lower(component), ":-", "/_")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]{3,}"), F.lit(0))
    kept = F.filter(words, lambda t: ~t.isin(GOAL_STOPWORDS))
    return kept if limit is None else F.slice(kept, 1, limit)


def descriptor_tokens(text: Column) -> Column:
    """Distinct words of 4 or more characters without generic architecture words, in text order."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), "[/.:-]", " "), F.lit("[a-z_][a-z0-9_]+"), F.lit(0))
    long = F.filter(words, lambda t: F.length(t) >= 4)
    return F.array_except(long, string_array(fixed.GENERIC_DESCRIPTOR_TOKENS))


def role_tokens(tokens: Column) -> Column:
    """Role words among ``tokens`` after applying the alias table."""
    aliases = F.create_map(*[F.lit(x) for pair in fixed.ROLE_ALIASES.items() for x in pair])
    named = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(aliases, t), t))
    return F.array_intersect(string_array(fixed.ROLE_TOKENS), F.array_distinct(named))


def is_adapter_like(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, string_array(fixed.ADAPTER_TOKENS))


def primary_role(roles: Column) -> Column:
    """Smallest role other than ``component``, which is the last resort."""
    return F.coalesce(F.array_min(F.array_remove(roles, "component")), F.lit("component"))


def _holds(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, string_array(words))


def split_role(tokens: Column) -> Column:
    """``render`` or ``assembly`` when the tokens are purely one of the two, else empty."""
    render, assembly = _holds(tokens, fixed.RENDER_TOKENS), _holds(tokens, fixed.ASSEMBLY_TOKENS)
    return F.when(render & ~assembly, "render").when(assembly & ~render, "assembly").otherwise("")


def mapper_subdomain(roles: Column, tokens: Column) -> Column:
    """``visual`` or ``migration`` for a mapper that is purely one of the two, else empty."""
    visual, moved = _holds(tokens, fixed.VISUAL_MAPPER_TOKENS), _holds(tokens, fixed.MIGRATION_MAPPER_TOKENS)
    kind = F.when(visual & ~moved, "visual").when(moved & ~visual, "migration").otherwise("")
    return F.when(F.array_contains(roles, "mapper"), kind).otherwise("")


def parser_subdomain(roles: Column, tokens: Column) -> Column:
    """``runtime``, ``local_version`` or ``version_grammar`` for a parser of one kind, else empty."""
    runtime = _holds(tokens, fixed.RUNTIME_PARSER_TOKENS)
    local = _holds(tokens, fixed.LOCAL_PARSER_TOKENS)
    grammar = _holds(tokens, fixed.GRAMMAR_PARSER_TOKENS)
    version = _holds(tokens, fixed.VERSION_PARSER_TOKENS)
    kind = (
        F.when(runtime & ~local & ~grammar, "runtime")
        .when(local & ~runtime & ~grammar, "local_version")
        .when((grammar | version) & ~runtime & ~local, "version_grammar")
        .otherwise("")
    )
    return F.when(F.array_contains(roles, "parser"), kind).otherwise("")


def suppressed_pair(
    split_l: Column, split_r: Column, mapper_l: Column, mapper_r: Column, parser_l: Column, parser_r: Column
) -> Column:
    """Two sides are deliberately different: render/assembly, visual/migration, or unlike parsers."""
    both_split = (split_l != "") & (split_r != "") & (split_l != split_r)
    both_mapper = (mapper_l != "") & (mapper_r != "") & (mapper_l != mapper_r)
    both_parser = (parser_l != "") & (parser_r != "") & (parser_l != parser_r)
    return both_split | both_mapper | both_parser


# Terms that tell what a question is about, in two languages.
INFRA_QUERY_TERMS = [
    "gateway",
    "proxy",
    "provider",
    "model",
    "api",
    "transport",
    "protocol",
    "session sync",
    "session",
    "llm call",
    "backend llm",
    "网关",
    "模型",
    "接口",
    "协议",
    "会话同步",
]
TEST_QUERY_TERMS = ["test", "tests", "pytest", "unit test", "integration test", "用例", "测试"]
INFRA_SUMMARY_TERMS = ["provider", "transport", "protocol", "gateway", "session sync", "api"]


def wants_infra(text: Column) -> Column:
    return F.lower(text).rlike("|".join(INFRA_QUERY_TERMS))


def wants_tests(text: Column) -> Column:
    return F.lower(text).rlike("|".join(TEST_QUERY_TERMS))


def is_infra(component: Column, layer_role: Column, summary: Column) -> Column:
    """Gateway by name, interface role, or one of the infra terms in the summary."""
    return (
        F.lower(component).contains("gateway")
        | (F.lower(layer_role) == "interface_adapter")
        | F.lower(summary).rlike("|".join(INFRA_SUMMARY_TERMS))
    )


def is_changelog_path(path: Column) -> Column:
    """The path names a changelog or release notes."""
    low = F.lower(norm_path(path))
    name = F.regexp_replace(file_name(low), "_", "-")
    names = ["changelog.md", "changes.md", "history.md", "release-notes.md", "releasenotes.md"]
    return name.isin(names) | name.contains("changelog") | low.rlike("release[-_]notes")


def has_active_heading(text: Column) -> Column:
    """A heading says unreleased/current/next, names a version, or carries a date."""
    return text.rlike(
        r"(?im)^\s{0,3}#{1,4}\s+(\[?(unreleased|current|next)\]?|\[?v?\d+\.\d+(\.\d+)?\]?|\d{4}-\d{2}-\d{2})"
    ) | text.rlike(r"(?im)^\s{0,3}#{1,4}\s+.*\d{4}-\d{2}-\d{2}")


def is_active_changelog(path: Column, text: Column) -> Column:
    return is_changelog_path(path) & has_active_heading(text)


def symbol_rank(name: Column) -> Column:
    """0 for tests, low-signal or short names; else 1 plus points for dots, capitals, underscores, length."""
    text = F.trim(F.coalesce(name, F.lit("")))
    leaf = F.lower(F.substring_index(text, ".", -1))
    low_leaf = leaf.isin(fixed.LOW_SIGNAL_SYMBOLS)
    dotted = text.contains(".")
    dull = text.isin(fixed.LOW_SIGNAL_SYMBOLS) | (F.length(text) < 4) | (low_leaf & ~dotted)

    def points(flag: Column, value: int) -> Column:
        return F.when(flag, value).otherwise(0)

    rank = (
        F.lit(1)
        + points(dotted, 4)
        + points(text.rlike(r"\p{Lu}"), 2)
        + points(text.contains("_") & ~text.startswith("_"), 1)
        + points(F.length(text) >= 12, 1)
        - points(low_leaf, 1)
    )
    return F.when(text.startswith("test_") | dull, 0).otherwise(F.greatest(F.lit(0), rank))


def symbol_leaf(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def symbol_parent(symbol: Column) -> Column:
    return F.when(symbol.contains("."), F.regexp_replace(symbol, r"\.[^.]*$", "")).otherwise("")


def variant_family_key(symbol: Column) -> Column:
    """Key shared by variants of one function (``load_v1``/``load_v2``, ``UpperBase.run``/``LowerBase.run``)."""
    leaf, parent = symbol_leaf(symbol), symbol_parent(symbol)
    leaf_tokens = all_name_tokens(leaf)
    family = F.filter(
        all_name_tokens(symbol_leaf(parent)), lambda t: ~t.isin(fixed.VARIANT_MEMBER_TOKENS)
    )
    version_words = F.array(F.lit("version"), F.lit("segment"))
    tail = F.when(leaf.isin(fixed.VERSION_SEGMENT_NAMES), version_words).otherwise(leaf_tokens)
    member = F.when(
        (parent != "") & (F.size(family) > 0) & (F.size(leaf_tokens) > 0), F.concat_ws(" ", F.concat(family, tail))
    ).otherwise("")

    # One pass over the words: a number after a label word, or glued to a word, marks a variant.
    def step(acc: Column, t: Column) -> Column:
        label = t.isin("phase", "step", "stage", "part")
        numeric = t.rlike(r"^\d+[a-z]?$")
        glued = F.coalesce(
            F.nullif(F.regexp_extract(t, r"^(phase|step|stage|part|v)\d+[a-z]?$", 1), F.lit("")),
            F.nullif(F.regexp_extract(t, r"^([a-z][a-z_]{2,}?)\d+[a-z]?$", 1), F.lit("")),
        )
        word = F.when(label, t).when(numeric, F.lit(None)).otherwise(F.coalesce(glued, t))
        return F.struct(
            F.when(word.isNull(), acc["words"]).otherwise(F.concat(acc["words"], F.array(word))).alias("words"),
            (acc["seen"] | (~label & (numeric | glued.isNotNull()))).alias("seen"),
        )

    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(False).alias("seen"))
    plain = F.aggregate(
        leaf_tokens,
        start,
        step,
        lambda acc: F.when(acc["seen"] & (F.size(acc["words"]) >= 2), F.concat_ws(" ", acc["words"])).otherwise(""),
    )
    return F.when(member != "", member).when(F.size(leaf_tokens) < 2, "").otherwise(plain)
