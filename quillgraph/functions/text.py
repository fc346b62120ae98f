"""String and array functions: names, tokens, packing, rendering. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Without a vocabulary file a token is a run of letters, digits and underscores, or one other visible character.
TOKEN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
#: Words of a query that are never identifiers.
COMMON_WORDS = (
    "the", "to", "and", "is", "in", "it", "of", "for", "that", "this", "with", "from", "refactor", "change", "modify", "update", "make",
    "how", "what", "why", "where", "when", "can", "will", "should", "async", "sync", "method", "class", "function", "add", "remove",
    "fix", "bug", "error", "issue", "implement", "create", "delete",
)
JAVA_FENCE = r"(?is)```\s*java\s*\r?\n(.*?)```"
NOT_METHODS = ("if", "for", "while", "switch", "catch", "synchronized", "return", "new", "throw", "else", "do", "try")
IMPORT_LIMIT, PATH_LINE_HOPS = 40, 4


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def token_count(text: Column) -> Column:
    """F1. Null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def vocabulary_token_count(path: str):
    """F1 with a tokenizers vocabulary file: exact ids, Arrow batches."""
    import pandas as pd

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        ids = Tokenizer.from_file(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([len(x.ids) for x in ids])

    return count


def method_id(fq_class: Column, name: Column, params: Column) -> Column:
    """class#name(types)."""
    return F.concat(fq_class, F.lit("#"), name, F.lit("("), F.array_join(params, ", "), F.lit(")"))


def base_id(chunk_id: Column) -> Column:
    """without the part suffix."""
    return F.regexp_replace(chunk_id, r"#part\d+$", "")


def simple_name(identifier: Column) -> Column:
    """after the last #, else after the last dot before any parenthesis; parameters are cut."""
    whole = base_id(identifier)
    head = F.substring_index(whole, "(", 1)
    return F.when(F.contains(whole, F.lit("#")), F.substring_index(F.substring_index(whole, "#", -1), "(", 1)).otherwise(F.substring_index(head, ".", -1))


def short_name(chunk_id: Column) -> Column:
    """Class.method."""
    head = F.substring_index(base_id(chunk_id), "(", 1)
    return F.concat_ws(".", F.substring_index(F.substring_index(head, "#", 1), ".", -1), F.when(F.contains(head, F.lit("#")), F.substring_index(head, "#", -1)))


def without_generics(name: Column) -> Column:
    """The characters outside all angle brackets, at any depth."""
    pieces = F.split(name, "(?=[<>])", -1)
    keep = lambda acc, x: F.struct(
        (acc["depth"] + F.when(F.startswith(x, F.lit("<")), 1).when(F.startswith(x, F.lit(">")), -1).otherwise(0)).alias("depth"),
        F.when(F.startswith(x, F.lit(">")) & (acc["depth"] == 1), F.concat(acc["out"], F.substring(x, 2, 1 << 30))).when((acc["depth"] == 0) & ~F.startswith(x, F.lit("<")), F.concat(acc["out"], x)).otherwise(acc["out"]).alias("out"),
    )
    nested = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), keep, lambda acc: acc["out"])
    return F.when(F.contains(name, F.lit("<")), nested).otherwise(name)


def canonical_id(identifier: Column) -> Column:
    """One spelling for declared and called ids: generics erased, parameter types by simple name, no part suffix."""
    flat = without_generics(base_id(identifier))
    head = F.substring_index(flat, "(", 1)
    inner = F.regexp_extract(flat, r"\((.*)\)$", 1)
    types = F.transform(F.split(inner, r"\s*,\s*"), lambda t: F.substring_index(F.trim(t), ".", -1))
    return F.when(F.contains(flat, F.lit("(")), F.concat(head, F.lit("("), F.array_join(types, ", "), F.lit(")"))).otherwise(flat)


def query_tokens(query: Column) -> Column:
    """F8."""
    return F.split(query, r"[\s,;:!?()\"']+")


def identifiers(query: Column) -> Column:
    """Tokens of over two characters, no common words, with a dot, a hash or mixed case; in order, with repeats."""
    return F.filter(
        query_tokens(query),
        lambda t: (F.length(t) > 2) & ~F.lower(t).isin(*COMMON_WORDS) & (F.contains(t, F.lit(".")) | F.contains(t, F.lit("#")) | ((t != F.lower(t)) & (t != F.upper(t)))),
    )


def squeeze(text: Column) -> Column:
    """white space runs become one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def visibility(signature: Column) -> Column:
    """F10."""
    s = F.trim(signature)
    out = F.when(s.isNull(), "package-private")
    for word in ("public", "protected", "private"):
        out = out.when(F.startswith(s, F.lit(word + " ")), word)
    for word in ("public", "protected", "private"):
        out = out.when(F.contains(s, F.lit(f" {word} ")), word)
    return out.otherwise("package-private")


def visibility_rank(visibility: Column) -> Column:
    """An unknown word counts as package-private."""
    return F.when(visibility == "public", 3).when(visibility == "protected", 2).when(visibility == "private", 0).otherwise(1)


def has_override(annotations: Column) -> Column:
    """@Override with or without parentheses, in any case."""
    return F.coalesce(F.exists(annotations, lambda a: F.lower(F.trim(a)).rlike(r"^@?override(\(|$)")), F.lit(False))


def java_blocks(text: Column) -> Column:
    """the insides of fenced Java blocks."""
    return F.regexp_extract_all(text, F.lit(JAVA_FENCE), F.lit(1))


def method_name_of(code: Column) -> Column:
    """the first word before a parenthesis that is no keyword; null if there is none."""
    names = F.regexp_extract_all(code, F.lit(r"(\w+)\s*\("), F.lit(1))
    return F.get(F.filter(names, lambda n: ~n.isin(*NOT_METHODS)), 0)


def normal_imports(imports: Column) -> Column:
    """trimmed, without `import` and `;`, distinct and sorted, java.lang dropped."""
    clean = F.transform(imports, lambda i: F.trim(F.regexp_replace(F.regexp_replace(F.trim(i), r"^import\s+", ""), r"\s*;+\s*$", "")))
    clean = F.transform(clean, lambda i: F.regexp_replace(i, r"^static\s+", "static "))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda i: i.isNotNull() & (i != "") & ~F.startswith(i, F.lit("java.lang.")))))


def import_present(declaration: Column, imports: Column) -> Column:
    """the same import, or a wildcard of its package (static apart), is there."""
    one = F.get(normal_imports(F.array(declaration)), 0)
    wild = F.concat(F.regexp_replace(one, r"\.[^.]*$", ""), F.lit(".*"))
    return F.coalesce(F.exists(normal_imports(imports), lambda i: (i == one) | (i == wild)), F.lit(False))


def pack_lines(text: Column, budget: int) -> Column:
    """greedy packing of lines into parts of at most `budget` tokens. A longer line stays whole; trailing empty lines are lost.

    The count starts anew with each part, so this is a fold over the lines; it finds where parts begin, and each is cut out once.
    """
    start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        flush = (acc["n"] + x["n"] > budget) & (x["i"] > F.element_at(acc["cuts"], -1))
        return F.struct(F.when(flush, F.concat(acc["cuts"], F.array(x["i"]))).otherwise(acc["cuts"]).alias("cuts"), (x["n"] + F.when(flush, 0).otherwise(acc["n"])).alias("n"))

    def parted(lines: Column) -> Column:
        counted = F.transform(lines, lambda x, i: F.struct(i.alias("i"), token_count(x).alias("n")))
        piece = lambda a, b: F.concat(F.array_join(F.slice(lines, a + 1, F.coalesce(b, F.size(lines)) - a), "\n"), F.lit("\n"))
        return let(F.aggregate(counted, start, step, lambda acc: acc["cuts"]), lambda cuts: F.zip_with(cuts, F.slice(cuts, 2, F.size(cuts)), piece))

    return let(F.split(F.regexp_replace(text, r"\n+\z", ""), "\n", -1), parted)


def split_code(code: Column, budget: int) -> Column:
    """F2 for code without a statement list: whole if it fits, else lines; empty gives one empty part."""
    return F.when(F.coalesce(code, F.lit("")) == "", F.array(F.lit(""))).when(token_count(code) <= budget, F.array(code)).otherwise(pack_lines(code, budget))


def embedding_text(class_name: Column, signature: Column, code: Column) -> Column:
    """F19."""
    return F.concat(class_name, F.lit(" "), signature, F.lit("\n"), code)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's argument is not copied into its uses, as a column is."""
    return F.transform(F.array(value), body)[0]


def render_path(nodes: Column, edges: Column) -> Column:
    """F16: one line up to four hops, else one line for each edge; no edge is the anchor itself."""
    arrow = lambda e: F.when(e["direction"] == "OUT", F.concat(F.lit(" -["), e["rel_type"], F.lit("]-> "))).otherwise(F.concat(F.lit(" <-["), e["rel_type"], F.lit("]- ")))
    line = F.concat(F.get(nodes, F.lit(0)), F.array_join(F.transform(edges, lambda e, i: F.concat(arrow(e), F.get(nodes, i + 1))), ""))
    rows = F.array_join(F.transform(edges, lambda e, i: F.concat(F.lit("  "), F.get(nodes, i), arrow(e), F.get(nodes, i + 1))), "\n")
    return F.when(F.size(edges) == 0, "(this is the anchor)").when(F.size(edges) <= PATH_LINE_HOPS, line).otherwise(rows)


def _listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("  - "), i, F.lit("\n"))), "")


def _part(condition: Column, *pieces: Column) -> Column:
    return F.when(condition, F.concat(*pieces)).otherwise(F.lit(""))


def prompt(c: str = "") -> Column:
    """a chunk as prompt text; c prefixes the column names. Imports end in one semicolon."""
    col = lambda n: F.col(c + n)
    text = lambda n: F.coalesce(col(n).cast("string"), F.lit(""))
    full = lambda n: F.coalesce(F.size(col(n)) > 0, F.lit(False))
    imports = normal_imports(F.coalesce(col("imports"), F.array().cast("array<string>")))
    more = F.size(imports) - IMPORT_LIMIT
    shown = F.transform(F.slice(imports, 1, IMPORT_LIMIT), lambda i: F.concat(F.lit("import "), i, F.lit(";")))
    return F.concat(
        F.lit("Class: "), text("class_name"), F.lit("\nFully Qualified: "), text("fq_class_name"), F.lit("\nFile: "), text("file_path"),
        F.lit("\nClass Signature: "), text("class_signature"), F.lit("\n"),
        _part(F.size(imports) > 0, F.lit("\nImports:\n"), _listed(shown), _part(more > 0, F.lit("  ... (+"), more.cast("string"), F.lit(" more imports)\n"))),
        _part(full("class_annotations"), F.lit("Class Annotations: "), F.array_join(col("class_annotations"), ", "), F.lit("\n")),
        _part(full("field_declarations"), F.lit("Fields:\n"), _listed(col("field_declarations"))),
        F.lit("\nMethod:\n  - "), text("method_signature"), F.lit("\n"),
        _part(full("method_annotations"), F.lit("  Annotations: "), F.array_join(col("method_annotations"), ", "), F.lit("\n")),
        F.lit("  Lines: "), text("start_line"), F.lit("-"), text("end_line"), F.lit("\n"),
        _part(col("total_parts") > 1, F.lit("  (Part "), text("part_index"), F.lit(" of "), text("total_parts"), F.lit(")\n")),
        F.lit("  Tokens: "), text("token_count"), F.lit("\n"),
        _part(full("calls"), F.lit("\nCalls:\n"), _listed(col("calls"))), _part(full("called_by"), F.lit("\nCalled By:\n"), _listed(col("called_by"))),
        F.lit("\nCode:\n"), text("code"), F.lit("\n"),
    )


def clamp(value: Column, low: float, high: float) -> Column:
    """F22."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
