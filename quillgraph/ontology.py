"""The graph's vocabulary: entity types, predicates, aliases and rules, and lookups over them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types, predicates, predicate aliases, forbidden combinations,
# subject types by predicate, domain labels, node colours.
ENTITY_TYPES = ["PERSON", "ORGANIZATION", "CONCEPT", "PRODUCT", "LOCATION", "EVENT", "LAW", "METRIC", "PROCESS", "DOCUMENT", "TECHNOLOGY", "PROVISION"]
PREDICATES = [
    "is_a", "instance_of", "part_of", "contains", "includes",
    "develops", "authors", "issues", "regulates", "manages", "governs",
    "performs", "enables", "causes", "requires", "produces", "applies_to",
    "affiliated_with", "located_in", "related_to", "influences", "depends_on",
]
PREDICATE_ALIASES = {
    "was_developed_by": "develops", "created_by": "develops", "built_by": "develops", "invented_by": "develops", "developed_by": "develops",
    "works_at": "affiliated_with", "employed_by": "affiliated_with", "works_for": "affiliated_with", "member_of": "affiliated_with",
    "is_a": "is_a", "is_an": "is_a", "type_of": "is_a", "instance_of": "instance_of",
    "is_part_of": "part_of", "belongs_to": "part_of",
    "uses": "performs", "employs": "performs", "utilizes": "performs",
    "regulated_by": "regulates", "managed_by": "manages", "governed_by": "governs", "issued_by": "issues", "authored_by": "authors",
}
FORBIDDEN = [
    ("METRIC", "develops", "PERSON"), ("METRIC", "regulates", "PERSON"), ("LOCATION", "regulates", "TECHNOLOGY"),
    ("METRIC", "affiliated_with", "ORGANIZATION"), ("EVENT", "develops", "CONCEPT"), ("METRIC", "performs", "PROCESS"),
    ("DOCUMENT", "causes", "PERSON"), ("PERSON", "part_of", "METRIC"), ("METRIC", "located_in", "PERSON"),
    ("TECHNOLOGY", "issues", "METRIC"), ("LAW", "affiliated_with", "METRIC"), ("METRIC", "governs", "ORGANIZATION"),
    ("LOCATION", "produces", "PERSON"), ("METRIC", "authors", "DOCUMENT"), ("METRIC", "develops", "TECHNOLOGY"),
    ("LOCATION", "requires", "PERSON"),
]
SUBJECT_TYPES = {
    "regulates": ["ORGANIZATION", "LAW", "PROVISION", "DOCUMENT"], "develops": ["ORGANIZATION", "PERSON", "TECHNOLOGY"],
    "issues": ["ORGANIZATION", "PERSON", "LAW"], "affiliated_with": ["PERSON", "ORGANIZATION"],
    "located_in": ["PERSON", "ORGANIZATION", "EVENT", "LOCATION"], "manages": ["PERSON", "ORGANIZATION"],
    "governs": ["ORGANIZATION", "LAW", "PROVISION"], "authors": ["PERSON", "ORGANIZATION"],
}
#: Words that tell each domain, for bag-of-words vectors; a model of embeddings would take sentences.
DOMAIN_LABELS = {
    "financial_regulatory": "bank loan interest rate inflation supervisor capital ratio audit disclosure",
    "legal": "court judge plaintiff defendant contract clause statute appeal liability",
    "technical_engineering": "software server processor circuit module interface protocol sensor design",
    "academic_research": "study hypothesis experiment sample method citation journal theory survey",
    "general_business": "company market customer strategy sales manager supplier meeting team",
}
TYPE_COLOURS = {
    "PERSON": "#FF6B6B", "ORGANIZATION": "#4ECDC4", "TECHNOLOGY": "#45B7D1", "CONCEPT": "#FFA07A",
    "PRODUCT": "#98D8C8", "LOCATION": "#F7DC6F", "EVENT": "#BB8FCE", "ENTITY": "#BDC3C7",
}

#: Our own wording of the instructions that go before a chunk.
INSTRUCTIONS = (
    'State every relation that the text asserts as one JSON object {"triples": [...]}; each item has subject, '
    "subject_type, predicate, target and target_type, the actor as subject, entities as short noun phrases. "
    f"Types: {', '.join(ENTITY_TYPES)}. Predicates: {', '.join(PREDICATES)}."
)
#: The keys of a triple in a completion.
TRIPLE_KEYS = ["subject", "subject_type", "predicate", "target", "target_type"]


def map_literal(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(d.items())])


def triple_json_schema(max_entity_chars: int = 80, max_triples: int = 20) -> dict:
    """JSON Schema that a completion endpoint is asked to honour."""
    name = {"type": "string", "minLength": 1, "maxLength": max_entity_chars}
    kind, predicate = {"type": "string", "enum": sorted(ENTITY_TYPES)}, {"type": "string", "enum": sorted(PREDICATES)}
    item = {
        "type": "object", "required": TRIPLE_KEYS, "additionalProperties": False,
        "properties": {"subject": name, "subject_type": kind, "predicate": predicate, "target": name, "target_type": kind},
    }
    return {"type": "object", "required": ["triples"], "additionalProperties": False, "properties": {"triples": {"type": "array", "maxItems": max_triples, "items": item}}}
