import json

import pytest
from pyspark.sql import types as T

from tessera.engine import Engine
from tessera.errors import ValidationError
from tessera.namespaces import RDF, RDFS, XSD, Namespace, namespace_iri, prefixes
from tessera.ontology import read_ontology, records
from tessera.sources.catalog import Catalog, quads_of
from tessera.sources.json_etl import Entity, insert_blocks, read_json
from tessera.sources.rdf import read_rdf, write_ntriples
from tessera.streaming.triples import append_quads, ntriples_stream, predicate_counts, quad_table

N = Namespace("http://example.org/n#")

ONTOLOGY = """
@prefix n: <http://example.org/n#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
n:Work a owl:Class ; rdfs:label "Work" . n:Book a owl:Class ; rdfs:subClassOf n:Work .
n:title a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain n:Work ; rdfs:range xsd:string .
n:pages a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain n:Book ; rdfs:range xsd:int .
n:author a owl:ObjectProperty ; rdfs:domain n:Work ; rdfs:range n:Person .
n:b1 a n:Book ; n:title "One" ; n:pages 12 ; n:author n:x , n:y . n:b2 a n:Book ; n:title "Two" .
"""


def test_ontology(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(ONTOLOGY)
    e = Engine(Catalog(spark, quads=quads_of(read_rdf(spark, str(tmp_path / "o.ttl")))))
    classes = read_ontology(e)
    book = classes[N.Book]
    assert [p.name for p in book.properties] == ["author", "pages", "title"] and classes[N.Work].label == "Work"
    assert book.schema()["pages"].dataType == T.LongType() and book.schema()["author"].dataType == T.ArrayType(T.StringType())
    got = {r["iri"]: r for r in records(e, book).collect()}
    assert got[N.b1]["pages"] == 12 and got[N.b1]["author"] == [N.x, N.y] and got[N.b2]["title"] == "Two" and got[N.b2]["author"] == []


def test_json(spark, tmp_path):
    issue = {"id": 7, "series": {"id": 3, "name": "S S"}, "price": 2.5, "credits": [{"id": 1, "creator": "A"}, {"id": 2, "creator": "B"}], "note": ""}
    (tmp_path / "i.json").write_text(json.dumps([issue, {"id": 8, "series": None, "credits": []}]))
    entities = [
        Entity("issue/{id}", (N.Issue,), values={N.price: ("price", XSD.decimal), N.note: "note", N.none: "missing.path"}, links={N.partOf: "work/{series.name}"}),
        Entity("work/{series.name}", (N.Work,), values={RDFS.label: "series.name"}),
        Entity("person/{it.id}", (N.Person,), each="credits", values={RDFS.label: "it.creator"}, constants={N.role: "credit"}),
        Entity("team/{it.id}", (N.Team,), each="teams"),
    ]
    e = Engine(Catalog(spark, quads=quads_of(read_json(spark, str(tmp_path / "i.json"), entities, "http://example.org/d/"))), {"n": N})
    assert e.query("SELECT ?w ?p WHERE { ?i n:partOf ?w ; n:price ?p }") == [{"w": "http://example.org/d/work/S%20S", "p": 2.5}]
    assert len(e.query("SELECT ?x WHERE { ?x a n:Person ; n:role 'credit' }")) == 2
    assert len(e.query("SELECT ?x WHERE { ?x a n:Issue }")) == 2


def test_blocks_and_load(spark, tmp_path):
    text = "PREFIX n: <http://example.org/n#> INSERT DATA { n:a n:p 1 } ;\nINSERT DATA { <http://example.org/n#b> <http://example.org/n#p> 2 } ;"
    e = Engine(Catalog(spark))
    for block in insert_blocks(text):
        e.update(block.rstrip(";"))
    assert len(e.query(f"SELECT ?s WHERE {{ ?s <{N.p}> ?o }}")) == 2
    write_ntriples(e.catalog.quads.select("s", "p", "o"), str(tmp_path / "out"))
    e.update(f"LOAD <file://{tmp_path}/out> INTO GRAPH <{N.g}> ; LOAD SILENT <file://{tmp_path}/none> ; CLEAR DEFAULT")
    assert len(e.query(f"SELECT ?s WHERE {{ GRAPH <{N.g}> {{ ?s <{N.p}> ?o }} }}")) == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text(f"<{N.a}> <{N.p}> <{N.b}> .\n<{N.a}> <{N.p}> <{N.b}> .\nnoise\n")
    s = ntriples_stream(spark, str(tmp_path / "in"))
    append_quads(s, str(tmp_path / "quads"), str(tmp_path / "state"), once=True).awaitTermination(120)
    (tmp_path / "in" / "b.nt").write_text(f"<{N.b}> <{N.p}> <{N.c}> .\n")
    append_quads(s, str(tmp_path / "quads"), str(tmp_path / "state"), once=True).awaitTermination(120)
    e = Engine(Catalog(spark, quads=quad_table(spark, str(tmp_path / "quads"))))
    assert sorted(r["y"] for r in e.query(f"SELECT ?y WHERE {{ <{N.a}> <{N.p}>+ ?y }}")) == [N.b, N.c]
    q = predicate_counts(s).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select n from counts").first()[0] == 3


def test_namespaces():
    assert namespace_iri("foaf") == "http://xmlns.com/foaf/0.1/" and prefixes("xsd") == {"xsd": str(XSD)}
    with pytest.raises(ValidationError):
        XSD.interger  # noqa: B018
    assert RDF["_12"].endswith("#_12") and RDFS.label.endswith("#label")
    assert XSD.integer == "http://www.w3.org/2001/XMLSchema#integer" and XSD.integer in XSD and N["a b"].endswith("a b")
