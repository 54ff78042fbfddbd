"""Schemas of the input tables. Keys are strings, measures are nullable doubles."""

from __future__ import annotations

from pyspark.sql import types as T

#: The measures of a reading, in file order.
MEASURES = (
    "nitrate_con r_exc m_exc temp_water ph spec_cond diss_oxy_con diss_oxy_sat chloro_v chloro_con turbi_mean turbi_var turbi_med "
    "turbi_bes turbi_min turbi_max dts_temp_water phosphate_con ph_v2 spec_cond_v2 diss_oxy_con_v2 diss_oxy_sat_v2 turbi_mean_v2"
).split()
#: The daily weather parameters.
WEATHER = "T2M T2M_MAX T2M_MIN PRECTOTCORR RH2M WS2M ALLSKY_SFC_SW_DWN".split()


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def both(*parts: T.StructType) -> T.StructType:
    return T.StructType([f for p in parts for f in p.fields])


RAW_READINGS = both(strings("site_uid", "datetime"), doubles(*MEASURES))
SITES = both(strings("uid"), doubles("latitude", "longitude"))
PARAMS = strings("uid", "label", "unit", "description", "private")
_CHUNK = both(strings("filename"), T.StructType([T.StructField("size_bytes", T.LongType())]))
MANIFEST = T.StructType(
    [T.StructField("original_filename", T.StringType()), T.StructField("total_rows", T.LongType()), T.StructField("chunk_size", T.LongType())]
    + [T.StructField("num_chunks", T.IntegerType()), T.StructField("chunks", T.ArrayType(_CHUNK))]
)
PIXELS = both(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())]), doubles("x", "y", "value"))
_SERIES = both(strings("monitoring_location_id", "parameter_code"), T.StructType([T.StructField("time", T.TimestampType())]), doubles("value"))
GAUGES = {
    "daily": _SERIES,
    "continuous": _SERIES,
    "series": strings("monitoring_location_id", "parameter_code"),
    "location": strings("monitoring_location_id", "monitoring_location_name", "geometry"),
}
