"""Small dimension tables, all of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..registry import BY_ID, DETECTORS, SEVERITIES

CLASSES = ("CREDENTIAL", "GOVERNMENT_IDENTIFIER", "FINANCIAL", "CONTACT", "PERSON_NAME", "QUASI_IDENTIFIER", "TECHNICAL_IDENTIFIER", "BUSINESS_ATTRIBUTE", "LOCATION")
# Destinations and their exposure.
DESTINATIONS = {"local": 0, "local_model": 0, "known_external": 2, "external_model": 3, "unknown": 4}
# Agents, their trust and whether they reach the network.
AGENTS = {"claude": ("medium", True), "cursor": ("medium", True), "codex": ("medium", True), "windsurf": ("medium", True), "cline": ("medium", True), "copilot": ("medium", True), "continue": ("medium", True), "local_model": ("high", False), "unknown": ("low", True)}
TOOLS = ("synthesize", "tokenize", "redact")
MODE_OF = {"synthesize": "fake", "tokenize": "typed", "redact": "redact"}
_STRICT, _SOFT = ("tokenize", "redact"), TOOLS
_EXTERNAL = {"CREDENTIAL": _STRICT, "GOVERNMENT_IDENTIFIER": _STRICT, "FINANCIAL": _STRICT, "CONTACT": _SOFT, "PERSON_NAME": _SOFT}
# Rules of the default policy by destination.
POLICY = {
    "local": {"denied": (), "prohibited": (), "restricted": (), "approval": (), "allowed": {}},
    "local_model": {"denied": (), "prohibited": ("CREDENTIAL",), "restricted": (), "approval": (), "allowed": {"CREDENTIAL": _STRICT}},
    "known_external": {"denied": (), "prohibited": ("CREDENTIAL", "GOVERNMENT_IDENTIFIER", "FINANCIAL"), "restricted": ("CONTACT", "PERSON_NAME"), "approval": (), "allowed": _EXTERNAL},
    "external_model": {"denied": (), "prohibited": ("CREDENTIAL", "GOVERNMENT_IDENTIFIER", "FINANCIAL", "CONTACT"), "restricted": ("PERSON_NAME", "TECHNICAL_IDENTIFIER"), "approval": ("CREDENTIAL",), "allowed": _EXTERNAL},
    "unknown": {"denied": ("CREDENTIAL",), "prohibited": ("GOVERNMENT_IDENTIFIER", "FINANCIAL", "CONTACT", "PERSON_NAME"), "restricted": ("QUASI_IDENTIFIER", "TECHNICAL_IDENTIFIER", "LOCATION", "BUSINESS_ATTRIBUTE"), "approval": ("GOVERNMENT_IDENTIFIER",), "allowed": _EXTERNAL},
}
# Needs by intent; a class that is not named has no stated need, and every need is data to edit.
KEYWORDS = {
    "analytics": ("calculate", "average", "group", "salary", "analysis", "statistics", "sum", "trend", "report"),
    "engineering": ("debug", "fix", "refactor", "deploy", "implement", "compile"),
    "communication": ("email", "reply", "letter", "message", "notify"),
    "narrative": ("summarise", "summarize", "story", "describe", "rewrite"),
    "migration": ("migrate", "convert", "import", "export"),
    "testing": ("test", "fixture", "mock", "sample data"),
}
NEEDS = {
    "analytics": {c: "REQUIRED_DISTINCT" for c in ("PERSON_NAME", "GOVERNMENT_IDENTIFIER", "QUASI_IDENTIFIER", "CONTACT", "FINANCIAL", "LOCATION")} | {"CREDENTIAL": "NOT_REQUIRED"},
    "engineering": {"PERSON_NAME": "NOT_REQUIRED"},
    "communication": {"CREDENTIAL": "NOT_REQUIRED", "CONTACT": "REQUIRED_SHAPE", "PERSON_NAME": "REQUIRED_SHAPE"},
    "narrative": {"CREDENTIAL": "NOT_REQUIRED", "PERSON_NAME": "REQUIRED_SHAPE"},
    "migration": {c: "REQUIRED_DISTINCT" for c in ("GOVERNMENT_IDENTIFIER", "CONTACT", "FINANCIAL")},
    "testing": {c: "REQUIRED_SHAPE" for c in CLASSES},
}
PREFERENCE = {"REQUIRED_DISTINCT": ("tokenize", "redact", "synthesize"), "REQUIRED_SHAPE": TOOLS, "NOT_REQUIRED": ("redact", "tokenize", "synthesize"), None: TOOLS}


def severity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.id, d.category, d.sensitivity, d.severity, SEVERITIES.index(d.severity)) for d in DETECTORS], "id string, cat string, class string, severity string, severity_rank int")


def articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.id, a) for d in DETECTORS for a in d.articles], "id string, article int")


def values_sql(kind: str) -> str:
    """The same tables as SQL VALUES."""
    if kind == "severity":
        rows = ", ".join(f"('{d.id}', '{d.category}', '{d.sensitivity}', '{d.severity}', {SEVERITIES.index(d.severity)})" for d in BY_ID.values())
        return f"(VALUES {rows}) AS dim(id, cat, class, severity, severity_rank)"
    rows = ", ".join(f"('{d.id}', {a})" for d in BY_ID.values() for a in d.articles)
    return f"(VALUES {rows}) AS bridge(id, article)"
