"""Parsers of model responses: JSON wherever it stands, else text. All are Column expressions over the response.

JSON is read as a variant, so that a field of another type counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clamp, let, strip

#: Where a response may hold its JSON object.
JSON_FENCE = r"(?s)```(?:json)?\s*\n?(\{.*?\})\s*\n?```"
SAFETY_KEYS = ("verdict", "safe", "confidence")
RESPONSE_KEYS = ("code_blocks", "explanation", "breaking_changes", "missing_references", "dependencies", "impact")
#: Text patterns.
CONFIDENCE = r"(?i)CONFIDENCE:\s*([0-9]*\.?[0-9]+)"
VERDICT = r"(?i)VERDICT:\s*(SAFE|UNSAFE)"
RISK_LINE = r"(?i)RISK:\s*[^|]+?\s*\|\s*SEVERITY:\s*(?:HIGH|MEDIUM|LOW)\s*(?:\|\s*MITIGATION:\s*[^\n]+)?"
NEEDS = r"(?is)NEEDS:\s*\n?(.*?)(?:\n\n|\z)"
JUDGE_VERDICT = r"(?i)VERDICT:\s*(PASS|FAIL)"
JUDGE_SCORE = r"(?i)SCORE:\s*([0-9]*\.?[0-9]+)"
JUDGE_FEEDBACK = r"(?is)FEEDBACK:\s*\n?(.*)"
MISSING = r"(?i)MISSING:\s*\[([^\]]*)]"
NEED_TO_SEE = (
    r"(?i)(?:need to see|need access to|please provide|missing context for|require the code of)\s+(?:the\s+)?(?:method\s+|class\s+)?[`'\"]?"
    r"([A-Z][A-Za-z0-9]*(?:\.[a-zA-Z][A-Za-z0-9]*)*)\b"
)
SAFE_PHRASES = ("no risks", "all clear", "change is safe", "refactoring is safe", "no breaking changes detected")
APPROVALS = ("lgtm", "looks good", "approved", "no issues found", "all correct")
HIGH_WORDS, LOW_WORDS = ("critical", "breaking", "compilation", "compile error"), ("minor", "cosmetic", "style")
CODE_SIGNS = ("public ", "private ", "class ", "void ", "return ", "import ")
SAFETY_SECTIONS = ("CONFIDENCE:", "VERDICT:", "RISKS:", "NEEDS:", "FEEDBACK:", "```")
RESPONSE_SECTIONS = ("CHANGES:", "EXPLANATION:", "BREAKING", "MISSING:", "RISK:", "```")
_STRINGS = "array<string>"


def _has(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out |= F.contains(low, F.lit(w))
    return out


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _object(text: Column) -> Column:
    """A variant if the text is a JSON object. It is parsed once for all that is read of it."""
    return let(F.try_parse_json(text), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def json_object(response: Column, keys: tuple[str, ...]) -> Column:
    """the fenced object, else the text from the first known key on to the last brace, else the whole text."""
    keyed = r"(?s)(\{\s*\"(?:" + "|".join(keys) + r")\"\s*:.*\})"
    return F.coalesce(_object(_found(response, JSON_FENCE)), _object(_found(response, keyed)), _object(strip(response)))


def _scalar(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _string(v: Column, *names: str) -> Column:
    """The first primitive field, as text; containers don't count."""
    plain = [F.when(~F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")).rlike("^(OBJECT|ARRAY)"), _scalar(v, n)) for n in names]
    return F.coalesce(*plain)


def _array(v: Column, name: str) -> Column:
    """Elements as variants; null if the field is no array."""
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def _texts(v: Column, name: str, drop_none: bool = True) -> Column:
    """trimmed primitives that aren't empty (and not "none"); null if the field is no array."""
    plain = F.filter(_array(v, name), lambda e: ~F.schema_of_variant(e).rlike("^(OBJECT|ARRAY)"))
    values = F.transform(plain, lambda e: strip(F.try_variant_get(e, "$", "string")))
    return F.filter(values, lambda s: s.isNotNull() & (s != "") & ((F.lower(s) != "none") if drop_none else F.lit(True)))


def _empty(kind: str = _STRINGS) -> Column:
    return F.array().cast(kind)


def _severity(word: Column) -> Column:
    up = F.upper(strip(word))
    return F.when(up.isin("HIGH", "MEDIUM", "LOW"), up).otherwise("MEDIUM")


def _risk(description: Column, severity: Column, mitigation: Column) -> Column:
    return F.struct(description.alias("description"), severity.alias("severity"), mitigation.alias("mitigation"))


def _json_risks(v: Column, *names: str) -> Column:
    def one(e: Column) -> Column:
        plain = _risk(F.try_variant_get(e, "$", "string"), F.lit("MEDIUM"), F.lit(""))
        whole = _risk(F.coalesce(_string(e, "description"), F.lit("Unknown risk")), _severity(F.coalesce(_string(e, "severity"), F.lit(""))), F.coalesce(_string(e, "mitigation"), F.lit("")))
        return F.when(F.startswith(F.schema_of_variant(e), F.lit("OBJECT")), whole).otherwise(plain)

    items = F.coalesce(*(_array(v, n) for n in names))
    kept = F.filter(items, lambda e: ~F.startswith(F.schema_of_variant(e), F.lit("ARRAY")))
    return F.coalesce(F.transform(kept, one), _empty("array<struct<description:string,severity:string,mitigation:string>>"))


def until_section(text: Column, headers: tuple[str, ...], skip: int = 0) -> Column:
    """The text up to the first header that stands after its start (and after `skip` characters); all of it without one."""
    low = F.lower(F.substring(text, skip + 1, 1 << 30))
    at = F.array_min(F.filter(F.array(*(F.instr(low, h.lower()) for h in headers)), lambda i: i > 1))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), (at - 1 + skip).cast("int")))


def after(text: Column, header: str) -> Column:
    """What follows a header, trimmed; null without it."""
    at = F.instr(F.lower(text), header.lower())
    return F.when(at > 0, strip(F.substring(text, (at + len(header)).cast("int"), F.lit(1 << 30))))


def _bullets(text: Column, numbered: bool) -> Column:
    mark = r"^([-*]\s|\d+\.\s)" if numbered else r"^[-*] "
    head = r"^[-*]\s+|^\d+\.\s+" if numbered else r"^[-*]\s+"
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, r"^\s+|\s+$", "")))
    found = F.transform(F.filter(lines, lambda x: x.rlike(mark)), lambda x: strip(F.regexp_replace(x, head, "")))
    return F.filter(found, lambda x: x != "")


def unstructured_severity(text: Column) -> Column:
    """L4."""
    return F.when(_has(text, HIGH_WORDS), "HIGH").when(_has(text, LOW_WORDS), "LOW").otherwise("MEDIUM")


def _text_risks(text: Column) -> Column:
    line = lambda s: _risk(strip(F.regexp_extract(s, r"(?i)RISK:\s*([^|]+?)\s*\|", 1)), F.upper(F.regexp_extract(s, r"(?i)SEVERITY:\s*(HIGH|MEDIUM|LOW)", 1)), strip(F.regexp_extract(s, r"(?i)MITIGATION:\s*([^\n]+)", 1)))
    tagged = F.transform(F.regexp_extract_all(text, F.lit(RISK_LINE), F.lit(0)), line)
    low = F.lower(text)
    at = F.when(F.instr(low, "risks:") > 0, F.instr(low, "risks:")).when(F.instr(low, "risk:") > 0, F.instr(low, "risk:"))
    section = until_section(F.substring(text, at.cast("int"), F.lit(1 << 30)), SAFETY_SECTIONS, 10)
    loose = F.filter(_bullets(section, False), lambda s: ~F.startswith(F.lower(s), F.lit("risk:")))
    loose = F.transform(loose, lambda s: _risk(s, unstructured_severity(s), F.lit("")))
    return F.when(F.size(tagged) > 0, tagged).otherwise(F.coalesce(loose, _empty("array<struct<description:string,severity:string,mitigation:string>>")))


def safety_verdict(response: Column) -> Column:
    """L1-L4: struct(safe, confidence, risks, needs, feedback, parsed_from_json). An explicit verdict always wins over a high confidence."""
    from_json = lambda v: F.struct(
        F.coalesce(F.lower(_string(v, "verdict")) == "safe", F.lower(_string(v, "safe")) == "true", F.lit(False)).alias("safe"),
        clamp(F.coalesce(_scalar(v, "confidence", "double"), F.lit(0.0)), 0.0, 1.0).alias("confidence"),
        _json_risks(v, "risks", "issues").alias("risks"),
        F.coalesce(F.when(F.size(_texts(v, "needs")) > 0, _texts(v, "needs")), _texts(v, "missing_context"), _empty()).alias("needs"),
        F.coalesce(_string(v, "feedback", "summary"), F.lit("")).alias("feedback"),
        F.lit(True).alias("parsed_from_json"),
    )
    said = _found(response, VERDICT)
    sure = F.coalesce(_found(response, CONFIDENCE).cast("double"), F.lit(0.0))
    needs = F.transform(F.regexp_extract_all(F.coalesce(_found(response, NEEDS), F.lit("")), F.lit(r"(?m)^\s*[-*]\s+(.+)$"), F.lit(1)), lambda s: F.regexp_replace(strip(s), r"[`'\"]", ""))
    told = after(response, "feedback:")
    from_text = F.struct(
        F.coalesce(F.upper(said) == "SAFE", _has(response, SAFE_PHRASES) | (sure >= 0.9)).alias("safe"),
        clamp(sure, 0.0, 1.0).alias("confidence"),
        _text_risks(response).alias("risks"),
        F.filter(needs, lambda s: (s != "") & ~F.lower(s).isin("none", "nothing")).alias("needs"),
        strip(F.coalesce(until_section(told, SAFETY_SECTIONS), response)).alias("feedback"),
        F.lit(False).alias("parsed_from_json"),
    )
    empty = F.struct(
        F.lit(False).alias("safe"), F.lit(0.0).alias("confidence"), _empty("array<struct<description:string,severity:string,mitigation:string>>").alias("risks"), _empty().alias("needs"),
        F.lit("Empty analyzer response").alias("feedback"), F.lit(False).alias("parsed_from_json"))
    parsed = let(json_object(response, SAFETY_KEYS), lambda v: F.when(v.isNotNull(), from_json(v)))
    return F.when(F.coalesce(strip(response), F.lit("")) == "", empty).otherwise(F.coalesce(parsed, from_text))


def distributed_verdict(response: Column) -> Column:
    """As L1, but only safe, confidence, issues, missing_context and summary count, and text gives safe and confidence at most."""
    from_json = lambda v: F.struct(
        F.coalesce(F.lower(_string(v, "safe")) == "true", F.lit(False)).alias("safe"), clamp(F.coalesce(_scalar(v, "confidence", "double"), F.lit(0.0)), 0.0, 1.0).alias("confidence"),
        _json_risks(v, "issues").alias("issues"), F.coalesce(_texts(v, "missing_context", False), _empty()).alias("missing_context"),
        F.coalesce(_string(v, "summary"), F.lit("")).alias("summary"), F.lit(True).alias("parsed_from_json"))
    nothing = _empty("array<struct<description:string,severity:string,mitigation:string>>")
    text = lambda summary: F.struct(
        F.coalesce(F.lower(_found(response, r"(?i)\"?safe\"?\s*[:=]\s*(true|false)")) == "true", F.lit(False)).alias("safe"),
        clamp(F.coalesce(_found(response, r"(?i)\"?confidence\"?\s*[:=]\s*([0-9]*\.?[0-9]+)").cast("double"), F.lit(0.0)), 0.0, 1.0).alias("confidence"),
        nothing.alias("issues"), _empty().alias("missing_context"), F.lit(summary).alias("summary"), F.lit(False).alias("parsed_from_json"))
    blank = F.coalesce(strip(response), F.lit("")) == ""
    parsed = let(json_object(response, ("safe",)), lambda v: F.when(v.isNotNull(), from_json(v)))
    return F.when(blank, text("Empty analyzer response")).otherwise(F.coalesce(parsed, text("WARNING: Could not parse JSON from analyzer. Raw text used as fallback.")))


def verdict_json(verdict: Column) -> Column:
    """The verdict as JSON text."""
    return F.to_json(F.struct(*(verdict[n].alias(n) for n in ("safe", "confidence", "issues", "missing_context", "summary"))))


def judge_verdict(response: Column) -> Column:
    """struct(passed, score, feedback, issues)."""
    blank = F.coalesce(strip(response), F.lit("")) == ""
    passed = F.coalesce(F.upper(_found(response, JUDGE_VERDICT)) == "PASS", _has(response, APPROVALS))
    score = clamp(F.coalesce(_found(response, JUDGE_SCORE).cast("double"), F.when(passed, 1.0).otherwise(0.0)), 0.0, 1.0)
    feedback = F.regexp_replace(F.coalesce(_found(response, JUDGE_FEEDBACK), response), r"^\s+|\s+$", "")
    empty = F.struct(F.lit(False).alias("passed"), F.lit(0.0).alias("score"), F.lit("Empty judge response").alias("feedback"), _empty().alias("issues"))
    return F.when(blank, empty).otherwise(F.struct(passed.alias("passed"), score.alias("score"), feedback.alias("feedback"), _bullets(feedback, True).alias("issues")))


def missing_references(text: Column) -> Column:
    """F15."""
    inner = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MISSING), F.lit(1)), lambda s: F.split(s, ",")))
    listed = F.array_distinct(F.filter(F.transform(inner, lambda s: strip(F.regexp_replace(strip(s), r"[`'\"]", ""))), lambda s: s != ""))
    asked = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(NEED_TO_SEE), F.lit(1)), lambda s: s != ""))
    return F.when(F.size(listed) > 0, listed).otherwise(asked)


def breaking_changes(text: Column) -> Column:
    """bullets of the section; without bullets its text, unless it says that there are none."""
    low = F.lower(text)
    at = F.when(F.instr(low, "breaking change") > 0, F.instr(low, "breaking change")).when(F.instr(low, "breaking:") > 0, F.instr(low, "breaking:"))
    section = until_section(strip(F.substring(text, at.cast("int"), F.lit(1 << 30))), RESPONSE_SECTIONS, 20)
    bullets = _bullets(section, True)
    rest = strip(F.regexp_replace(section, r"(?i)^BREAKING[^:]*:?\s*", ""))
    plain = F.when((F.length(section) > 20) & (rest != "") & (F.lower(rest) != "none") & ~F.contains(F.lower(rest), F.lit("no breaking changes")), F.array(rest)).otherwise(_empty())
    return F.when(at.isNull(), _empty()).when(F.size(bullets) > 0, bullets).otherwise(plain)


def explanation(text: Column) -> Column:
    """the section, else what follows the last Java block."""
    named = strip(until_section(after(text, "explanation:"), RESPONSE_SECTIONS))
    tail = strip(F.regexp_extract(text, r"(?s).*```java\s*\n.*?```(.*)$", 1))
    return F.coalesce(named, strip(F.regexp_extract(tail, r"(?is)^(.*?)(?:BREAKING|MISSING:|\z)", 1)), F.lit(""))


def code_text(text: Column) -> Column:
    """Fenced Java blocks, else unnamed blocks that look like Java."""
    tidy = lambda blocks: F.transform(blocks, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    java = tidy(F.regexp_extract_all(text, F.lit(r"(?s)```java\s*\n(.*?)```"), F.lit(1)))
    other = F.filter(tidy(F.regexp_extract_all(text, F.lit(r"(?s)```\s*\n(.*?)```"), F.lit(1))), lambda s: F.exists(F.array(*map(F.lit, CODE_SIGNS)), lambda w: F.contains(s, w)))
    return F.array_join(F.when(F.size(java) > 0, java).otherwise(other), "\n\n")


def _known(v: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out |= F.try_variant_get(v, f"$.{n}", "variant").isNotNull()
    return out


def refactor_response(response: Column) -> Column:
    """struct(code, explanation, missing_references, breaking_changes, parsed_from_json)."""
    blocks = lambda v: F.transform(_array(v, "code_blocks"), lambda e: F.when(F.startswith(F.schema_of_variant(e), F.lit("OBJECT")), _string(e, "code")).otherwise(F.try_variant_get(e, "$", "string")))
    code = lambda v: F.array_join(F.transform(F.filter(blocks(v), lambda s: s.isNotNull()), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), "\n\n")
    make = lambda c, e, m, b, j: F.struct(c.alias("code"), e.alias("explanation"), m.alias("missing_references"), b.alias("breaking_changes"), F.lit(j).alias("parsed_from_json"))
    from_json = lambda v: make(F.coalesce(code(v), F.lit("")), F.coalesce(_string(v, "explanation"), F.lit("")), F.coalesce(_texts(v, "missing_references"), _empty()), F.coalesce(_texts(v, "breaking_changes"), _empty()), True)
    from_text = make(code_text(response), explanation(response), missing_references(response), breaking_changes(response), False)
    empty = make(F.lit(""), F.lit(""), _empty(), _empty(), False)
    fields = ("code_blocks", "explanation", "breaking_changes", "missing_references")
    parsed = let(json_object(response, RESPONSE_KEYS), lambda v: F.when(v.isNotNull() & _known(v, fields), from_json(v)))
    return F.when(F.coalesce(strip(response), F.lit("")) == "", empty).otherwise(F.coalesce(parsed, from_text))


def analysis_response(response: Column) -> Column:
    """struct(dependencies, impact, missing_references, parsed_from_json)."""
    make = lambda d, i, m, j: F.struct(d.alias("dependencies"), i.alias("impact"), m.alias("missing_references"), F.lit(j).alias("parsed_from_json"))
    from_json = lambda v: make(F.coalesce(_texts(v, "dependencies"), _empty()), F.coalesce(_string(v, "impact"), F.lit("")), F.coalesce(_texts(v, "missing_references"), _empty()), True)
    text = make(_empty(), F.lit(""), missing_references(F.coalesce(response, F.lit(""))), False)
    fields = ("dependencies", "impact", "missing_references")
    return F.coalesce(let(json_object(response, RESPONSE_KEYS), lambda v: F.when(v.isNotNull() & _known(v, fields), from_json(v))), text)


def edit_ops(response: Column) -> Column:
    """Array of the edit operations in `ops`; unknown kinds are dropped."""
    fields = {
        "replace_method": ("fq_class_name", "method_name", "original_signature", "new_code"), "add_method": ("fq_class_name", "new_code"),
        "delete_method": ("fq_class_name", "method_name", "original_signature"), "add_import": ("file_path", "import_decl"), "create_file": ("rel_path", "content"),
    }
    names = ("fq_class_name", "method_name", "original_signature", "new_code", "file_path", "import_decl", "rel_path", "content")

    def one(e: Column) -> Column:
        kind = F.lower(_string(e, "kind"))
        own = lambda n: F.when(kind.isin(*(k for k, f in fields.items() if n in f)), F.coalesce(_string(e, n), F.lit("")))
        return F.struct(kind.alias("kind"), *(own(n).alias(n) for n in names))

    return F.filter(F.transform(_array(json_object(response, ("ops", *RESPONSE_KEYS)), "ops"), one), lambda o: o["kind"].isin(*fields))


def code_blocks(response: Column) -> Column:
    """Array of struct(class, method, code) for responses without ops."""
    v = json_object(response, RESPONSE_KEYS)
    one = lambda e: F.struct(F.coalesce(_string(e, "class"), F.lit("")).alias("class"), _string(e, "method").alias("method"), _string(e, "code").alias("code"))
    return F.filter(F.transform(_array(v, "code_blocks"), one), lambda b: (b["method"] != "") & (b["code"] != ""))


def is_safe(verdict: Column, threshold: float = 0.9, risks: str = "risks") -> Column:
    """A safe verdict, sure enough, without a high risk."""
    return verdict["safe"] & (verdict["confidence"] >= threshold) & ~F.exists(verdict[risks], lambda r: r["severity"] == "HIGH")


def severity_count(risks: Column, severity: str) -> Column:
    """A11."""
    return F.size(F.filter(risks, lambda r: r["severity"] == severity))


def same_risks(a: Column, b: Column) -> Column:
    """As many risks, with equal descriptions in any case, place by place."""
    low = lambda x: F.transform(x, lambda r: F.lower(r["description"]))
    return F.coalesce(low(a) == low(b), F.lit(False))


def distinct_needs(needs: Column, most: int) -> Column:
    """Of an array of lists, distinct and sorted, the first `most`."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(needs))), 1, most)
