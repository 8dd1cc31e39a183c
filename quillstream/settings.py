"""Settings of a service: arguments, the session's configuration, the environment, defaults, in that order."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.quillstream."
# Names of the environment variables, and the encoder without one.
VARIABLES = {"generator_key": "GOOGLE_API_KEY", "encoder_model": "RAG_EMBED_MODEL"}
ENCODER = "sentence-transformers/all-MiniLM-L6-v2"
# End of fixed values.


@dataclass(frozen=True)
class Settings:
    """What plug-ins need to find their models and services.

    ``from_session`` takes each field from ``spark.quillstream.<field>`` or from the
    environment variable that VARIABLES names for it; an empty string is no value."""

    generator_key: str | None = None
    encoder_model: str = ENCODER
    candidate_k: int = 20
    top_k: int = 5
    max_chunks: int = 1200

    @classmethod
    def from_session(cls, spark: SparkSession | None = None, **given) -> Settings:
        found = {}
        for f in fields(cls):
            value = given.get(f.name)
            if value in (None, "") and spark is not None:
                value = spark.conf.get(PREFIX + f.name, None)
            if value in (None, "") and f.name in VARIABLES:
                value = os.environ.get(VARIABLES[f.name])
            if value not in (None, ""):
                found[f.name] = int(value) if f.type == "int" else value
        return cls(**found)
