"""The graph's data model and the ontology of entities and relationships."""

from __future__ import annotations

from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("vid", T.StringType(), False), T.StructField("tag", T.StringType(), False), T.StructField("label", T.StringType()), T.StructField("props", T.MapType(T.StringType(), T.StringType()))])
EDGE = T.StructType([T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("edge_type", T.StringType(), False), T.StructField("rank", T.LongType(), False), T.StructField("props", T.MapType(T.StringType(), T.StringType()))])

# Entity types, relationship endpoints, connector classes, limits.
ENTITY_TYPES = ("Person", "Company", "Organization", "Address", "Country", "Document", "Phone", "Email", "BankAccount", "Vehicle")
DIRECT = ("RELATED_TO", "PAYS", "COMMUNICATED_WITH", "TRANSFERRED_TO")
SHARED = ("HAS_FIELD_VALUE", "HAS_PHONE", "HAS_EMAIL", "HAS_DOCUMENT", "HAS_ACCOUNT", "OWNS_VEHICLE", "LOCATED_AT", "WORKS_AT", "OWNS")
WEAK = ("CITIZEN_OF",)
BRIDGE = ("PAYS", "OWNS", "RELATED_TO", "TRANSFERRED_TO", "SHAREHOLDER_OF", "DIRECTOR_OF")
BRIDGE_TAGS = ("company", "organization")
MAX_FANOUT, MAX_PERSONS, DEGREE_CAP, CONNECTION_CAP = 25, 300, 3, 4
FIELD_EDGE, FIELD_TAG, EXPANDABLE_TAGS = "HAS_FIELD_VALUE", "field_value", ("document",)
WEIGHTS = {
    **dict.fromkeys(("passport_number", "national_id", "emirates_id", "number", "iban", "document"), 0.95),
    "bank_account": 0.9,
    **dict.fromkeys(("phone", "email", "vehicle"), 0.8),
    **dict.fromkeys(("father_name", "mother_name", "address", "dob", "place_of_birth"), 0.7),
    **dict.fromkeys(("company", "organization"), 0.4),
}
DEFAULT_WEIGHT, CROSS_KEY, DIRECT_CONFIDENCE, BRIDGE_CONFIDENCE = 0.5, 0.6, 0.9, 0.4

# Relationship types and the entity types that each may join.
_ACTORS = ("Person", "Company", "Organization")
ENDPOINTS = {
    "WORKS_AT": (("Person",), ("Company", "Organization")),
    "OWNS": (_ACTORS, ("Company", "Organization", "Vehicle")),
    "PAYS": (_ACTORS, _ACTORS),
    "HAS_DOCUMENT": (("Person",), ("Document",)),
    "HAS_PHONE": (_ACTORS, ("Phone",)),
    "HAS_EMAIL": (_ACTORS, ("Email",)),
    "HAS_ACCOUNT": (_ACTORS, ("BankAccount",)),
    "OWNS_VEHICLE": (_ACTORS, ("Vehicle",)),
    "LOCATED_AT": (_ACTORS, ("Address",)),
    "CITIZEN_OF": (("Person",), ("Country",)),
}
RELATIONSHIPS = (*ENDPOINTS, "RELATED_TO")
