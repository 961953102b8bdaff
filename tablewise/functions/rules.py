"""Fixed values of the analysis rules: word lists, thresholds, patterns and texts."""

from __future__ import annotations

# ---- fixed values: semantic types -------------------------------------------------------------
CATEGORY_MAX_RATIO = 0.05
CATEGORY_MAX_UNIQUE = 50
ID_MIN_RATIO = 0.95
ID_KEYWORD_MIN_UNIQUE = 10
ID_KEYWORD_MIN_RATIO = 0.001
ID_BARE_MIN_RATIO = 0.99
ID_BARE_MIN_UNIQUE = 100
DATE_MIN_VALUES = 10
DATE_MIN_SHARE = 0.85
NUMERIC_TEXT_MIN_SHARE = 0.95
SEQUENCE_MAX_GAP = 0.05
SAMPLE_VALUES = 5

ID_WORDS = (
    "id", "code", "key", "uuid", "guid", "ref", "reference",
    "number", "num", "no", "nr", "sku", "identifier",
)
CURRENCY_WORDS = (
    "price", "revenue", "sales", "amount", "cost", "value",
    "payment", "fee", "charge", "income", "profit", "margin",
    "spend", "budget", "salary", "wage", "earning", "total",
    "subtotal", "tax", "discount", "refund", "invoice",
)
DATE_WORDS = (
    "date", "time", "timestamp", "datetime", "created", "updated",
    "modified", "at", "on", "year", "month", "day", "week",
    "period", "quarter", "when", "start", "end", "due", "deadline",
)
BOOLEAN_PREFIXES = ("is_", "has_")
BOOLEAN_SETS = (
    ("yes", "no"),
    ("true", "false"),
    ("y", "n"),
    ("1", "0"),
    ("t", "f"),
)

# ---- fixed values: cleaning -------------------------------------------------------------------
NULL_TOKENS = (
    "n/a", "na", "n.a.", "null", "none", "nil", "missing",
    "unknown", "-", "--", "---", "?", "not available",
    "not applicable", "#n/a", "#null!", "nan",
)
OUTLIER_SPREAD = 3.0
OUTLIER_MIN_VALUES = 10
UNKNOWN_TEXT = "Unknown"

# ---- fixed values: quality score --------------------------------------------------------------
POINTS_NULL_COLUMN = 5
POINTS_MANY_NULLS = 10
POINTS_DUPLICATES = 15
POINTS_OUTLIERS = 5
POINTS_MIXED_TYPE = 8
NULLS_WARNING = 0.05
NULLS_CRITICAL = 0.30
DUPLICATES_LIMIT = 0.01
QUALITY_LEVELS = ((90, "excellent"), (75, "good"), (50, "moderate"), (0, "poor"))
IMPUTATION_TEXT = {
    "currency": "missing values will be filled with the column median",
    "numeric": "missing values will be filled with the column median",
    "category": "missing values will be filled with the most frequent value (mode)",
    "text": "missing values will be filled with the most frequent value (mode)",
    "datetime": "rows with missing dates will be flagged but not removed",
    "id": "rows with missing IDs will be dropped (cannot join without a key)",
    "boolean": "missing values will be filled with False",
}

# ---- fixed values: relationships --------------------------------------------------------------
MATCH_HIGH = 0.80
MATCH_MIN = 0.50
NAME_ABBREVIATIONS = (
    ("cust", "customer"),
    ("prod", "product"),
    ("ord", "order"),
    ("inv", "invoice"),
    ("emp", "employee"),
    ("dept", "department"),
    ("cat", "category"),
    ("addr", "address"),
)
KEY_SUFFIX = r"[_\-]?(id|key|code|ref|no|num|number|uuid|guid)$"
LABEL_SUFFIX = r"[_\-]?(id|key|code|ref)$"

# ---- fixed values: metrics --------------------------------------------------------------------
METRIC_BLOCKED = (
    "product_name_lenght", "product_name_length",
    "product_description_lenght", "product_description_length",
    "product_photos_qty",
    "product_weight_g", "product_length_cm",
    "product_height_cm", "product_width_cm",
    "zip_code", "zip_code_prefix", "customer_zip_code_prefix",
    "seller_zip_code_prefix", "geolocation_zip_code_prefix",
    "order_item_id",
)
CUSTOMER_HINTS = ("customer", "user", "client", "buyer", "member", "subscriber")
ORDER_HINTS = ("order", "transaction", "invoice", "sale", "purchase")
PRODUCT_HINTS = ("product", "item", "sku", "good", "merchandise")
SELLER_HINTS = ("seller", "vendor", "merchant", "supplier", "store")
REVENUE_EXACT = (
    "revenue", "sales", "net_sales", "gross_sales", "gmv", "gross_merchandise_value",
    "payment_value", "order_total", "transaction_amount", "transaction_value",
    "sales_amount", "sales_value", "net_revenue", "gross_revenue",
)
REVENUE_WORDS = ("amount", "payment", "value", "total")
REVENUE_NEGATIVE = (
    "cost", "price", "unit_price", "discount", "tax", "freight", "shipping",
    "weight", "margin", "profit", "fee", "commission",
)
REVENUE_CONTEXT = ("order", "transaction", "sale", "invoice", "payment")
REVENUE_SCORES = {
    "exact": 100, "contains": 35, "negative": -80, "word": 15, "bare_word": -100, "context": 10,
}
SPAN_DATE_HINTS = ("purchase", "order", "created", "date", "timestamp", "start")
CATEGORY_GEO_WORDS = ("city", "state", "zip", "code", "prefix", "geo", "region_code")
STATUS_OWNERS = ("order", "delivery", "shipment")
METRIC_CATEGORY_ORDER = ("sales", "customer", "inventory", "general")
DELIVERED = "delivered"

# ---- fixed values: generated views ------------------------------------------------------------
VIEW_DATE_HINTS = ("date", "created", "purchase", "timestamp")
VIEW_VALUE_HINTS = ("revenue", "total", "amount", "price", "value")
VIEW_ENTITY_HINTS = ("customer", "user", "client", "entity")

# ---- fixed values: charts ---------------------------------------------------------------------
CHART_BLOCKED = (
    "product_name_lenght", "product_name_length",
    "product_description_lenght", "product_description_length",
    "product_photos_qty",
    "product_weight_g", "product_length_cm",
    "product_height_cm", "product_width_cm",
    "zip_code", "zip_code_prefix",
    "customer_zip_code_prefix", "seller_zip_code_prefix",
    "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
    "order_item_id", "review_id",
)
CHART_BAD_CATEGORIES = ("zip", "code", "prefix", "geo", "uuid", "hash")
CHART_SIZE_WORDS = (
    "weight", "length", "height", "width", "lenght",
    "qty", "photos", "zip", "code", "prefix",
)
CHART_DATE_HINTS = ("purchase", "order", "created", "date", "timestamp")
CHART_VALUE_HINTS = ("revenue", "total", "amount", "payment", "price", "value")
CHART_GROUP_VALUE_HINTS = ("revenue", "total", "amount", "payment", "price")
CHART_HISTOGRAM_HINTS = ("price", "value", "amount", "revenue", "total")
CHART_CROSS_VALUE_HINTS = ("price", "value", "amount", "revenue", "total", "payment")
PIE_MAX_VALUES = 8
TREEMAP_ABOVE = 11
UNKNOWN_CARDINALITY = 999
CHART_POINTS = 500

# ---- fixed values: monitoring -----------------------------------------------------------------
MONITOR_DAYS = 30
MONITOR_MIN_SPAN = 59
RATE_LEVELS = (10.0, 15.0, 20.0)
REVENUE_LEVELS = (20.0, 30.0, 40.0)
OTHER_LEVELS = (25.0, 37.5, 50.0)
SCENARIO_ALIASES = {
    "total revenue": "revenue",
    "revenue": "revenue",
    "total orders": "orders",
    "orders": "orders",
    "total customers": "customers",
    "customers": "customers",
}

# ---- fixed values: request log ----------------------------------------------------------------
DYNAMIC_PATH = r"/[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,}|/\d+"
DURATION_BUCKETS = ((0.5, "le_0_5"), (2.0, "le_2"))
DURATION_OVER = "gt_2"

# ---- fixed values: files ----------------------------------------------------------------------
FILE_EXTENSIONS = (".csv", ".parquet", ".zip")

# ---- fixed values: models ---------------------------------------------------------------------
CHURN_FEATURES = (
    "total_orders",
    "total_spend",
    "avg_order_value",
    "days_since_last_order",
    "customer_tenure_days",
    "avg_review_score",
)
CHURN_AFTER_DAYS = 180
CHURN_WARN_DAYS = 90
RFM_COLUMNS = ("days_since_last_order", "total_orders", "total_spend")
SEGMENT_NAMES = ("Champions", "Loyal", "At Risk", "Lost")
# texts a CSV reader takes as missing without being told
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
ZIP_METADATA = "__MACOSX"
