"""Schemas and fixed column lists.

Fixed values (must equal the recorded sensor data layout): the sensor CSV has these 16 columns,
in this order, bound by position -- index, UTC, Temperature[C], Humidity[%], TVOC[ppb], eCO2[ppm],
Raw H2, Raw Ethanol, Pressure[hPa], PM1, PM2_5, NC0_5, NC1_0, NC2_5, CNT, Fire Alarm.
"""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: sensor reading layout (name, type), positional
SENSOR_COLUMNS = [
    ("index", T.LongType()),
    ("UTC", T.LongType()),
    ("Temperature[C]", T.DoubleType()),
    ("Humidity[%]", T.DoubleType()),
    ("TVOC[ppb]", T.LongType()),
    ("eCO2[ppm]", T.LongType()),
    ("Raw H2", T.LongType()),
    ("Raw Ethanol", T.LongType()),
    ("Pressure[hPa]", T.DoubleType()),
    ("PM1", T.DoubleType()),
    ("PM2_5", T.DoubleType()),
    ("NC0_5", T.DoubleType()),
    ("NC1_0", T.DoubleType()),
    ("NC2_5", T.DoubleType()),
    ("CNT", T.IntegerType()),
    ("Fire Alarm", T.IntegerType()),
]
SENSOR_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in SENSOR_COLUMNS])
SENSOR_LABEL = "Fire Alarm"
SENSOR_DROP = ("index", "CNT", "UTC")

# The stand-in readings table built from the test data (see FIXTURES.md).
READING_KEY = "o_orderkey"
READING_FEATURES = ["n_items", "sum_qty", "sum_price", "avg_disc", "avg_tax"]
LABEL = "label"

# Positional CSV schema for the readings stand-in: header names in the file are ignored, the
# declared names win (the same binding rule as the sensor CSV).
READING_CSV_SCHEMA = T.StructType(
    [T.StructField("row_key", T.LongType(), True)]
    + [T.StructField(f"f_{c}", T.DoubleType(), True) for c in READING_FEATURES]
    + [T.StructField("alarm", T.IntegerType(), True)]
)

# Declared schema for JSON reading lines on the stream (no per-batch inference).
READING_JSON_SCHEMA = T.StructType(
    [T.StructField(READING_KEY, T.LongType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in READING_FEATURES]
    + [T.StructField(LABEL, T.DoubleType(), True)]
)

PROPS_SCHEMA = T.StructType([T.StructField("k", T.LongType(), True)])
