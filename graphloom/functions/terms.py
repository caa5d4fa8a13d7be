"""Terms as canonical strings: tests, parts and values, as Column expressions.

``<iri>``, ``_:blank``, ``?variable``, ``"plain"``, ``"text"@lang``, ``"lexical"^^<datatype>``; NULL is no term.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import INTEGER, RDF, STRING, XML_LITERAL

LITERAL = r'(?s)\A"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\z'


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _part(x, group: int) -> Column:
    """A part of a literal; '' for what the literal lacks, NULL for other terms."""
    return F.when(is_literal(x), F.regexp_extract(_c(x), LITERAL, group))


def is_iri(x) -> Column:
    return F.coalesce(_c(x).startswith("<"), F.lit(False))


def is_blank(x) -> Column:
    return F.coalesce(_c(x).startswith("_:"), F.lit(False))


def is_variable(x) -> Column:
    return F.coalesce(_c(x).startswith("?"), F.lit(False))


def is_literal(x) -> Column:
    return F.coalesce(_c(x).startswith('"'), F.lit(False))


def datatype(x) -> Column:
    return _part(x, 3)


def language(x) -> Column:
    return F.lower(_part(x, 2))


def is_typed(x) -> Column:
    return is_literal(x) & (datatype(x) != "")


def is_untyped(x) -> Column:
    """Plain or language literals."""
    return is_literal(x) & (datatype(x) == "")


def is_xml(x) -> Column:
    return is_typed(x) & (datatype(x) == XML_LITERAL)


def has_datatype(x, dtype) -> Column:
    """The literal x has the datatype that the IRI term ``dtype`` names."""
    return F.coalesce(is_iri(dtype) & (F.concat(F.lit("<"), datatype(x), F.lit(">")) == _c(dtype)), F.lit(False))


def is_member(x) -> Column:
    """rdf:_n, with any number of digits."""
    return F.coalesce(_c(x).rlike(rf"\A<{RDF.replace('.', chr(92) + '.')}_[0-9]*>\z"), F.lit(False))


def escape(text) -> Column:
    t = _c(text)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


#: An escape or a run of other characters. Fixed value.
PIECE = r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"


def unescape(text) -> Column:
    """The text that escapes stand for: \\n, \\r, \\t, quotes, backslashes, and characters by their number."""
    t = _c(text)
    plain = {"\\n": "\n", "\\r": "\r", "\\t": "\t", '\\"': '"', "\\'": "'", "\\\\": "\\"}

    def piece(x: Column) -> Column:
        out = F.when(x.rlike(r"\A\\[uU][0-9A-Fa-f]{4}"), F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32"))
        for k, v in plain.items():
            out = out.when(x == k, F.lit(v))
        return out.otherwise(x)

    return F.when(t.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(PIECE), F.lit(0)), piece), "")).otherwise(t)


def lexical(x) -> Column:
    """The text of a literal, '' for other terms."""
    return F.coalesce(unescape(_part(x, 1)), F.lit(""))


def name_of(x) -> Column:
    """The IRI without brackets, '' for other terms."""
    return F.when(is_iri(x), F.regexp_extract(_c(x), r"(?s)\A<(.*)>\z", 1)).otherwise("")


def iri(prefix: str, key) -> Column:
    return F.concat(F.lit(f"<{prefix}"), _c(key).cast("string"), F.lit(">"))


def plain(text) -> Column:
    return F.concat(F.lit('"'), escape(text), F.lit('"'))


def tagged(text, lang) -> Column:
    return F.concat(F.lit('"'), escape(text), F.lit('"@'), F.lower(_c(lang)))


def typed(text, dtype: str) -> Column:
    return F.concat(F.lit('"'), escape(_c(text).cast("string")), F.lit(f'"^^<{dtype}>'))


def integer(value) -> Column:
    # digits need no escapes
    return F.concat(F.lit('"'), _c(value).cast("decimal(38,0)").cast("string"), F.lit(f'"^^<{INTEGER}>'))


def as_integer(x) -> Column:
    """The value of an xsd:integer literal as DECIMAL(38,0); NULL for other terms and lexical forms."""
    # what does not match is '', which has no value
    lex = F.regexp_extract(_c(x), rf'\A"([+-]?[0-9]+)"\^\^<{INTEGER}>\z', 1)
    return F.when(_c(x).endswith(f'"^^<{INTEGER}>'), lex.try_cast("decimal(38,0)"))


def string(text) -> Column:
    return typed(text, STRING)


def same_value(a, b) -> Column:
    """Literals that stand for one value: of one datatype with one canonical form, or one text as plain and xsd:string."""
    kind = lambda x: F.when(_c(x).endswith('"'), F.lit(STRING)).otherwise(datatype(x))
    value = lambda x: F.when(datatype(x) == INTEGER, as_integer(x).cast("string")).otherwise(lexical(x))
    return F.coalesce(is_literal(a) & is_literal(b) & (kind(a) == kind(b)) & language(a).eqNullSafe(language(b)) & (value(a) == value(b)), F.lit(False))


def language_matches(x, tag: str) -> Column:
    """The literal's language is ``tag`` or one of its subtags, in any case."""
    return F.coalesce((language(x) == tag.lower()) | language(x).startswith(tag.lower() + "-"), F.lit(False))


def canonical(x) -> Column:
    """An xsd:integer or xsd:string literal in canonical form, NULL if its lexical form has no value."""
    return F.when(_c(x).endswith(f'"^^<{INTEGER}>'), integer(as_integer(x))).when(_c(x).endswith(f'"^^<{STRING}>') & (datatype(x) == STRING), _c(x))


def plain_to_typed(x) -> Column:
    return F.when(is_literal(x) & _c(x).endswith('"'), F.concat(_c(x), F.lit(f"^^<{STRING}>")))


def typed_to_plain(x) -> Column:
    return F.when(datatype(x) == STRING, F.regexp_replace(_c(x), r"\^\^<[^>]*>\z", ""))


def to_blank(x) -> Column:
    """Variables become blanks of the same name."""
    return F.when(is_variable(x), F.regexp_replace(_c(x), r"\A\?", "_:")).otherwise(_c(x))


def skolem(rule: str, *keys) -> Column:
    """A blank node of its own for each rule and key values, the same in every run."""
    return F.concat(F.lit("_:sk"), F.sha2(F.concat_ws("|", F.lit(rule), *map(_c, keys)), 256))


def split_uri(x) -> tuple[Column, Column]:
    """Namespace and the longest local name at the end of an IRI's text."""
    local = F.regexp_extract(_c(x), r"([A-Za-z_][A-Za-z0-9_.-]*)\z", 1)
    return F.left(_c(x), F.length(_c(x)) - F.length(local)), local
