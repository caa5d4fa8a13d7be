"""Namespaces and names. They are part of the data model."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}


def iri(name: str) -> str:
    """``<...>`` of a prefixed name; other terms stay as they are."""
    prefix, colon, local = name.partition(":")
    return f"<{PREFIXES[prefix]}{local}>" if colon and prefix in PREFIXES else name


TYPE, FIRST, REST, NIL = (iri(f"rdf:{x}") for x in ("type", "first", "rest", "nil"))
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (iri(f"rdfs:{x}") for x in ("subClassOf", "subPropertyOf", "domain", "range"))
ALLOCATED = iri("rdf:_allocatedTo")
INTEGER, STRING, XML_LITERAL = f"{XSD}integer", f"{XSD}string", f"{RDF}XMLLiteral"

#: Restrictions, and the relations of two datatypes. Fixed values.
RDFD = "http://id.ninebynine.org/2003/rdfext/rdfd#"
XSD_INTEGER_NS = "http://id.ninebynine.org/2003/XMLSchema/integer#"
XSD_STRING_NS = "http://id.ninebynine.org/2003/XMLSchema/string#"
