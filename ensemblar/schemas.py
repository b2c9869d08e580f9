"""Schemas of the engine's tables; no reader infers them."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(ddl: str) -> T.StructType:
    fields = []
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "doubles": T.ArrayType(T.DoubleType()), "ints": T.ArrayType(T.IntegerType())}
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind]))
    return T.StructType(fields)


SESSIONS = _of("session_id string, subject_id string, age int, weight double, rate_hz double, n_frames int, n_cells int, activity_threshold double")
ACTIVITY = _of("session_id string, cell int, frame int")
TRANSIENTS = _of("session_id string, cell int, transient_id long, first int, last int")
TRACES = _of("session_id string, cell int, frame int, kind string, value double")
PREDICTIONS = _of("session_id string, cell int, frame int, method string, probs doubles")
PERIODS = _of("session_id string, label string, period_id long, first int, last int")
INTERVALS = _of("session_id string, label string, t0 double, t1 double")
EVENTS = _of("session_id string, event_id long, first int, last int")
EVENT_CELLS = _of("session_id string, event_id long, cell int")
SIGNALS = _of("session_id string, channel string, i long, t double, value double")
CLOCK = _of("session_id string, stream string, frame int, t double")
CELLS = _of("session_id string, cell int, cx double, cy double, is_interneuron boolean")
PIXELS = _of("session_id string, frame int, x int, y int, v double")
EDGES = _of("session_id string, kind string, src int, dst int, weight double")
