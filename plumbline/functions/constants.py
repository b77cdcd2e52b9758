"""Fixed values that results depend on."""

# Numbers that stand for "missing" in tables.
SENTINELS = (-9999.0, -999.0, -999.9, -99999.0, -99.99, -8888.0, 9.96921e36, 1e20)
# Extremes that look like undeclared fill values.
FILL_EXTREMES = (-9999.0, -999.0, -999.9, -99999.0, -32767.0, -32768.0, 65535.0, 32767.0)
FILL_MAGNITUDE = 9.9e19
# Limits of the trend tests.
TREND_MIN_POINTS, SEASONAL_SHARE, Z95 = 6, 0.2, 1.959963984540054
EXTREME_Z, SKEW_LIMIT, EXTREMES_KEPT = 5.0, 3.0, 5
# Limits of the event rules.
EVENT_RATE, EVENT_MIN_ROWS, CELL_DEGREES, BUSY_SHARE, CATEGORY_MAX, CORRELATION_MIN, SERIES_MAX = 1.5, 10, 0.5, 0.002, 20, 0.3, 200
# Terrain classes in degrees.
SLOPE_LIMITS = (5, 10, 15, 25)
# Retrieval.
CHUNK_WORDS, CHUNK_STRIDE, TOP_PASSAGES = 400, 350, 6
# Vegetation classes from, to.
NDVI_CLASSES = (("water_snow_lt0", -1.0, 0.0), ("bare_0_0.1", 0.0, 0.1), ("sparse_0.1_0.3", 0.1, 0.3), ("moderate_0.3_0.6", 0.3, 0.6), ("dense_ge0.6", 0.6, 1.0001))
# Words that never count as keywords.
STOP_WORDS = tuple("a an the and or of to in on for with by from at as is are was were be been this that these those it its we our they their can may not no which between using used use than more most also has have had into over such both each other".split())
