"""All registered queries of the analytics engine and their oracle SQL."""

from __future__ import annotations

from functools import partial

from tradelens.operators.activity import ACTIVITY_QUERIES
from tradelens.operators.market import MARKET_QUERIES
from tradelens.operators.skill import SKILL_QUERIES
from tradelens.plans.dialect import duckdb_text, spark_frame
from tradelens.plans.documents import DOCUMENT_ORACLES, DOCUMENT_QUERIES
from tradelens.plans.frames import FRAME_ORACLES, FRAMES
from tradelens.plans.modelling import MODEL_ORACLES, MODEL_QUERIES
from tradelens.plans.oracles import WRITTEN
from tradelens.plans.scaled import SCALED_QUERIES
from tradelens.plans.site import SITE_ORACLES, SITE_QUERIES
from tradelens.plans.world import ALL_VIEWS, SPARK_VIEWS, STORED

TEXTS = ACTIVITY_QUERIES | SKILL_QUERIES | MARKET_QUERIES

QUERIES = {name: partial(spark_frame, query=SCALED_QUERIES.get(name, text), views=SPARK_VIEWS, stored=STORED) for name, text in TEXTS.items()} | FRAMES | DOCUMENT_QUERIES | MODEL_QUERIES | SITE_QUERIES
#: Hand-written SQL where there is one, else the query's own text in the other dialect.
ORACLES: dict[str, str] = {name: duckdb_text(text, ALL_VIEWS) for name, text in TEXTS.items()} | FRAME_ORACLES | DOCUMENT_ORACLES | MODEL_ORACLES | SITE_ORACLES | WRITTEN
