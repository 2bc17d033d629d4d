"""Fixed values.

Every constant below must equal the value the original forecasting service
uses, otherwise features, flags and labels differ. They are kept together,
as plain text, in their natural order.
"""

# --- fixed values: time grid -------------------------------------------------
BIN_MINUTES = 15

# --- fixed values: standard trip schema (names and order) --------------------
TRIP_COLUMNS = ("pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID")
YELLOW_RENAMES = {
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
}

# --- fixed values: zone hints (TLC location ids) -----------------------------
# airports: JFK 132, LGA 138 and 244, EWR 1
AIRPORT_ZONES = (1, 132, 138, 244)
# Manhattan core: 4..12 and 43..81 (inclusive) plus eight extra ids
MANHATTAN_CORE_RANGES = ((4, 12), (43, 81))
MANHATTAN_CORE_EXTRA = (161, 162, 163, 164, 170, 186, 234, 237)
ZONE_MIN, ZONE_MAX = 1, 263
DEFAULT_ZONE = 161

# --- fixed values: calendar ---------------------------------------------------
DEFAULT_HOLIDAYS = ("2025-01-01", "2025-01-20", "2025-02-17", "2025-12-25")
RUSH_HOURS = ((7, 9), (17, 19))  # inclusive hour ranges
WEEKEND_FROM_DOW = 5  # Monday = 0 .. Sunday = 6

# --- fixed values: surge levels (upper bounds, exclusive) ---------------------
SURGE_LEVELS = (
    (0.8, "Low Demand"),
    (1.2, "Normal"),
    (1.5, "Moderate Surge"),
    (2.0, "High Surge"),
)
SURGE_TOP_LEVEL = "Extreme Surge"

# --- fixed values: recommendation texts ---------------------------------------
RECOMMENDATIONS = (
    (0.8, "Supply exceeds demand. Consider reducing active driver incentives."),
    (1.2, "Balanced market conditions. Maintain current operations."),
    (1.5, "Moderate demand pressure. Consider 1.2-1.4x surge pricing."),
    (2.0, "Activate surge pricing (1.5-1.8x) and send driver alerts."),
)
RECOMMENDATION_TOP = (
    "Extreme surge conditions. Implement maximum pricing (2.0x+) and emergency driver activation."
)
RAIN_SUFFIX = " Rain detected - expect sustained high demand."
RAIN_PRECIP_ABOVE = 1.0

# --- fixed values: key-factor tags --------------------------------------------
TAG_RAIN = "Rain impact"
TAG_MORNING_RUSH = "Morning rush"
TAG_EVENING_RUSH = "Evening rush"
TAG_HIGH_VELOCITY = "High velocity"
TAG_LOW_SUPPLY = "Low supply"
HIGH_VELOCITY_ABOVE = 20.0
LOW_SUPPLY_BELOW = 0.5

# --- fixed values: confidence from tree dispersion ----------------------------
CONFIDENCE_MIN, CONFIDENCE_MAX = 0.15, 0.98
CONFIDENCE_ONE_TREE = 0.85
CONFIDENCE_ON_FAILURE = 0.80
ERROR_BAND_LEVEL = 0.8

DEFAULT_STATION = "nyc"

# --- fixed values: metrics ----------------------------------------------------
MAPE_EPSILON = 1e-8

# --- fixed values: request fields (camelCase name, snake_case alias) ----------
REQUEST_FLOAT_FIELDS = (
    ("supplyElasticity", "supply_elasticity"),
    ("lagDER15", "lag_der_15"),
    ("lagDER30", "lag_der_30"),
    ("demandVelocity", "demand_velocity"),
    ("lagDemandVelocity15", "lag_demand_velocity_15"),
    ("temp", "temp"),
    ("precip", "precip"),
)
REQUEST_INT_FIELDS = (("hour", "hour", 0, 23), ("dayOfWeek", "day_of_week", 0, 6))
REQUEST_OPTIONAL_FIELDS = (
    ("zoneId", "zone_id"),
    ("month", "month"),
    ("isHoliday", "is_holiday"),
    ("derRollingMean1h", "der_rolling_mean_1h"),
    ("derRollingStd1h", "der_rolling_std_1h"),
)
# order in which defaulted optional fields are reported
DEFAULTS_ORDER = ("month", "isHoliday", "derRollingMean1h", "derRollingStd1h")
MISSING_FEATURES_SHOWN = 8

# --- fixed values: UI bounds (field, min, max, step); DER rows use the config --
UI_BOUNDS = (
    ("zoneId", 1.0, 263.0, None),
    ("hour", 0.0, 23.0, None),
    ("dayOfWeek", 0.0, 6.0, None),
    ("supplyElasticity", 0.0, 10.0, 0.05),
    ("lagDER15", None, None, 0.05),
    ("lagDER30", None, None, 0.05),
    ("demandVelocity", -200.0, 200.0, 1.0),
    ("lagDemandVelocity15", -200.0, 200.0, 1.0),
    ("temp", -30.0, 45.0, 0.5),
    ("precip", 0.0, 50.0, 0.1),
)
INT_UI_FIELDS = ("zoneId", "hour", "dayOfWeek")

# --- fixed values: model manifest ---------------------------------------------
TARGET = "Target_DER_t+15"
EXCLUDE_FROM_FEATURES = (
    "Time_Bin", "ActiveRequests", "AvailableDriversProxy", "DER_t", "Target_DER_t+15",
)
EXCLUDE_FROM_X = (
    "Time_Bin", "Target_DER_t+15", "DER_t", "ActiveRequests", "AvailableDriversProxy", "hour",
)
REQUIRED_PROCESSED = ("Time_Bin", "Zone", "Target_DER_t+15", "Lag_DER_t-15", "DER_t")
EXPECTED_OUTPUTS = ("aggregated_temp.parquet", "train_data.parquet", "test_data.parquet")
