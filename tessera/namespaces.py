"""Vocabularies: `FOAF.name` and `FOAF["name"]` give full IRIs; `PREFIXES` are known to every query.

Vocabularies with a closed list of names refuse others, so that a slip of the pen is an error and not an empty result.
"""

from __future__ import annotations

from tessera.errors import ValidationError


class Namespace(str):
    """An IRI prefix whose attributes and items are IRIs in it; with names, in a closed vocabulary."""

    names: frozenset[str] | None = None

    def __new__(cls, iri: str, names: str = "") -> Namespace:
        out = super().__new__(cls, iri)
        out.names = frozenset(names.split()) or None
        return out

    def _iri(self, local: str) -> str:
        if self.names is not None and local not in self.names and not (local[:1] == "_" and local[1:].isdigit()):
            raise ValidationError(f"{str(self)} has no {local!r}")
        return str(self) + local

    def __getattr__(self, local: str) -> str:
        if local.startswith("__"):
            raise AttributeError(local)
        return self._iri(local[:-1] if local.endswith("_") else local)

    def __getitem__(self, local):  # noqa: ANN001
        return self._iri(local) if isinstance(local, str) else str.__getitem__(self, local)

    def __contains__(self, iri: object) -> bool:
        return isinstance(iri, str) and iri.startswith(str(self))


# The published IRIs of these vocabularies, and the names of those that are closed.
DC = Namespace("http://purl.org/dc/elements/1.1/")
DCTERMS = Namespace("http://purl.org/dc/terms/")
FOAF = Namespace("http://xmlns.com/foaf/0.1/")
GEO = Namespace("http://www.w3.org/2003/01/geo/wgs84_pos#")
GEOF = Namespace("http://www.opengis.net/def/function/geosparql/")
GEOSPARQL = Namespace("http://www.opengis.net/ont/geosparql#")
OWL = Namespace(
    "http://www.w3.org/2002/07/owl#",
    "AllDifferent AllDisjointClasses AllDisjointProperties Annotation AnnotationProperty AsymmetricProperty Axiom Class DataRange "
    "DatatypeProperty DeprecatedClass DeprecatedProperty FunctionalProperty InverseFunctionalProperty IrreflexiveProperty "
    "NamedIndividual NegativePropertyAssertion Nothing ObjectProperty Ontology OntologyProperty ReflexiveProperty Restriction "
    "SymmetricProperty Thing TransitiveProperty allValuesFrom annotatedProperty annotatedSource annotatedTarget assertionProperty "
    "backwardCompatibleWith bottomDataProperty bottomObjectProperty cardinality complementOf datatypeComplementOf deprecated "
    "differentFrom disjointUnionOf disjointWith distinctMembers equivalentClass equivalentProperty hasKey hasSelf hasValue imports "
    "incompatibleWith intersectionOf inverseOf maxCardinality maxQualifiedCardinality members minCardinality "
    "minQualifiedCardinality onClass onDataRange onDatatype onProperties onProperty oneOf priorVersion propertyChainAxiom "
    "propertyDisjointWith qualifiedCardinality rational real sameAs someValuesFrom sourceIndividual targetIndividual targetValue "
    "topDataProperty topObjectProperty unionOf versionIRI versionInfo withRestrictions",
)
PROV = Namespace("http://www.w3.org/ns/prov#")
RDF = Namespace(
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "Alt Bag CompoundLiteral HTML JSON List PlainLiteral Property Seq Statement XMLLiteral direction first langString language nil "
    "object predicate rest subject type value",
)
RDFS = Namespace(
    "http://www.w3.org/2000/01/rdf-schema#",
    "Class Container ContainerMembershipProperty Datatype Literal Resource comment domain isDefinedBy label member range seeAlso "
    "subClassOf subPropertyOf",
)
RESULTS = Namespace("http://www.w3.org/2005/sparql-results#")
SCHEMA = Namespace("http://schema.org/")
SD = Namespace("http://www.w3.org/ns/sparql-service-description#")
SH = Namespace("http://www.w3.org/ns/shacl#")
SKOS = Namespace("http://www.w3.org/2004/02/skos/core#")
VOID = Namespace("http://rdfs.org/ns/void#")
XSD = Namespace(
    "http://www.w3.org/2001/XMLSchema#",
    "ENTITIES ENTITY ID IDREF IDREFS NCName NMTOKEN NMTOKENS NOTATION Name QName anyAtomicType anySimpleType anyType anyURI "
    "base64Binary boolean byte date dateTime dateTimeStamp dayTimeDuration decimal double duration float gDay gMonth gMonthDay gYear "
    "gYearMonth hexBinary int integer language long negativeInteger nonNegativeInteger nonPositiveInteger normalizedString "
    "positiveInteger short string time token unsignedByte unsignedInt unsignedLong unsignedShort yearMonthDuration",
)

PREFIXES = {
    "dc": DC, "dcterms": DCTERMS, "dct": DCTERMS, "foaf": FOAF, "geo": GEO, "geof": GEOF, "geosparql": GEOSPARQL,
    "owl": OWL, "prov": PROV, "rdf": RDF, "rdfs": RDFS, "schema": SCHEMA, "sd": SD, "sh": SH, "skos": SKOS,
    "void": VOID, "xsd": XSD,
}


def namespace_iri(name: str) -> str:
    """IRI of a known prefix; KeyError if unknown."""
    return str(PREFIXES[name])


def prefixes(*names: str) -> dict[str, str]:
    """Prefix map of the named vocabularies, or of all."""
    return {n: str(PREFIXES[n]) for n in names or PREFIXES}
