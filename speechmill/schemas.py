"""Schemas of the entities, as DDL. Order is data, so every entity carries an ordinal (``seq`` or ``pos``)."""

from __future__ import annotations

LOG_VERSION = 1

LOG = "v INT, type STRING, id STRING, session STRING, audio STRING, seconds DOUBLE, text STRING, dictated STRING, continues BOOLEAN"
UTTERANCES = "id STRING, session STRING, audio STRING, seconds DOUBLE, `index` INT, of INT, continues BOOLEAN, phone STRING, refined STRING, status STRING, dictated STRING, field STRING"
HYPOTHESES = "system STRING, id STRING, hyp STRING"
REVIEWED = "id STRING, grade STRING, text STRING"
LABELS = "id STRING, session STRING, audio STRING, seconds DOUBLE, text STRING, grade STRING, source STRING, joins ARRAY<STRING>, `group` INT, fold INT"
MANIFEST = "id STRING, audio STRING, text STRING, `group` STRING, grade STRING"
REPLAY = "id STRING, audio STRING, text STRING, seconds DOUBLE"
TERMS = "pos BIGINT, term STRING"
WEIGHTS = "name STRING, is_float BOOLEAN, values ARRAY<FLOAT>"
FRAMES = "id STRING, t INT, feat ARRAY<FLOAT>"
