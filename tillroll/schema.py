"""Schemas, column names and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw transaction columns; all eight are required (extra columns pass through).
RAW_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
               "UnitPrice", "CustomerID", "Country"]
REQUIRED_COLUMNS = RAW_COLUMNS
NUMERIC_COLUMNS = ["Quantity", "UnitPrice"]

# Files arrive as text: every raw column is read as a string and cast by ``clean``.
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

RAW_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType(), True),
    T.StructField("StockCode", T.StringType(), True),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Quantity", T.DoubleType(), True),
    T.StructField("InvoiceDate", T.TimestampNTZType(), True),
    T.StructField("UnitPrice", T.DecimalType(22, 6), True),
    T.StructField("CustomerID", T.StringType(), True),
    T.StructField("Country", T.StringType(), True),
])

# Prices and quantities keep six decimals inside products, and a product keeps six decimals.
PRICE_TYPE = T.DecimalType(22, 6)
QTY_DECIMAL = T.DecimalType(18, 6)
VALUE_TYPE = T.DecimalType(38, 6)

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the studied application's behaviour)
# ---------------------------------------------------------------------------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SEGMENTS = ["Low", "Medium", "High", "VIP"]
UNKNOWN_CUSTOMER = "Unknown"
UNKNOWN_PRODUCT = "Unknown Product"
UNKNOWN_COUNTRY = "Unknown"
FLAG_EXTREME_QTY = "Extreme quantity"
FLAG_EXTREME_PRICE = "Extreme price"
EXTREME_FACTOR = 3            # value > 3 x q99 is extreme
EXTREME_QUANTILE = 0.99
QUALITY_PENALTY = 0.7         # score multiplier per extreme flag
SUSPICIOUS_MIN_ROWS = 3       # more than 3 rows of one invoice in one minute
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SUPPORTED_EXTENSIONS = [".csv", ".xlsx", ".xls"]
TOP_CUSTOMERS = 10
TOP_PRODUCTS = 10
TOP_COUNTRIES = 5
TOP_PERFORMERS = {"products": 5, "customers": 5, "countries": 3}
PARETO_SHARE = 0.2
HISTOGRAM_BINS = 50
MIN_INVOICES_FOR_AI = 10
