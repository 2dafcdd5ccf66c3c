"""The catalogue of data types.

A data type is one ``DatasetSpec``. Adding a data type means adding a spec; no
other module has to change.
"""

from __future__ import annotations

from dataclasses import dataclass

# How a payload is laid out.
RECORDS = "records"  # [{...}, {...}]
ENVELOPE = "envelope"  # {"historical": [{...}, ...]}; only the inner array is stored
NESTED_OBJECT = "nested_object"  # {"profile": {...}, ...}
NESTED_MAP = "nested_map"  # {"breakdown": {period: {segment: value}}}

SHAPES = (RECORDS, ENVELOPE, NESTED_OBJECT, NESTED_MAP)


@dataclass(frozen=True)
class Field:
    """One displayed payload key: its name, SQL type and display label."""

    key: str
    sql_type: str
    label: str


@dataclass(frozen=True)
class DatasetSpec:
    data_type: str
    path: str
    request: str
    shape: str
    export_suffix: str
    fields: tuple[Field, ...]
    sort_key: str | None
    top_n: int | None = 10
    member: str | None = None
    required_key: str | None = None
    key_name: str = "symbol"
    key_case: str = "upper"

    def __post_init__(self) -> None:
        if self.shape not in SHAPES:
            raise ValueError(f"unknown payload shape {self.shape!r}")
        if self.sort_key is not None and self.sort_key not in self.keys:
            raise ValueError(f"{self.data_type}: sort key {self.sort_key!r} is not a field")

    @property
    def keys(self) -> list[str]:
        return [f.key for f in self.fields]

    @property
    def labels(self) -> dict[str, str]:
        return {f.key: f.label for f in self.fields}

    @property
    def record_ddl(self) -> str:
        """The displayed record as a STRUCT type."""
        return "STRUCT<" + ", ".join(f"`{f.key}`: {f.sql_type}" for f in self.fields) + ">"

    @property
    def payload_ddl(self) -> str:
        """The stored payload as a type for ``from_json``."""
        if self.shape == NESTED_OBJECT:
            return f"STRUCT<`{self.member}`: {self.record_ddl}>"
        if self.shape == NESTED_MAP:
            value = next(f.sql_type for f in self.fields if f.key == "value")
            return f"STRUCT<`{self.member}`: MAP<STRING, MAP<STRING, {value}>>>"
        return f"ARRAY<{self.record_ddl}>"


def _text(key: str, label: str) -> Field:
    return Field(key, "STRING", label)


def _number(key: str, label: str) -> Field:
    return Field(key, "DOUBLE", label)


_DATE = _text("date", "Date")

# API paths, request forms, payload keys, labels and export file suffixes.
CATALOG: tuple[DatasetSpec, ...] = (
    DatasetSpec(
        "price", "/v3/historical-price-full", "/{key}", ENVELOPE, "price",
        (_DATE, _number("open", "Open"), _number("high", "High"), _number("low", "Low"),
         _number("close", "Close"), _number("volume", "Volume")),
        sort_key="date", member="historical", required_key="historical",
    ),
    DatasetSpec(
        "dividends", "/v3/historical-price-full/stock_dividend", "/{key}", ENVELOPE, "dividends",
        (_DATE, _text("label", "Label"), _number("adjDividend", "Adjusted Dividend"),
         _number("dividend", "Dividend")),
        sort_key="date", member="historical", required_key="historical",
    ),
    DatasetSpec(
        "splits", "/v3/historical-price-full/stock_split", "/{key}", ENVELOPE, "splits",
        (_DATE, _number("numerator", "Numerator"), _number("denominator", "Denominator"),
         _text("splitRatio", "Split Ratio")),
        sort_key="date", member="historical", required_key="historical",
    ),
    DatasetSpec(
        "marketcap", "/v3/historical-market-capitalization", "/{key}", RECORDS, "marketcap",
        (_DATE, _number("marketCap", "Market Cap")),
        sort_key="date",
    ),
    DatasetSpec(
        "income", "/v3/income-statement", "/{key}", RECORDS, "income_statement",
        (_DATE, _number("revenue", "Revenue"), _number("netIncome", "Net Income"),
         _number("grossProfit", "Gross Profit"), _number("eps", "EPS")),
        sort_key="date",
    ),
    DatasetSpec(
        "balance", "/v3/balance-sheet-statement", "/{key}", RECORDS, "balance_sheet",
        (_DATE, _number("totalAssets", "Total Assets"),
         _number("totalLiabilities", "Total Liabilities"), _number("totalEquity", "Total Equity")),
        sort_key="date",
    ),
    DatasetSpec(
        "cashflow", "/v3/cash-flow-statement", "/{key}", RECORDS, "cash_flow",
        (_DATE, _number("operatingCashFlow", "Operating CF"),
         _number("investingCashFlow", "Investing CF"),
         _number("financingCashFlow", "Financing CF")),
        sort_key="date",
    ),
    DatasetSpec(
        "metrics", "/v3/key-metrics", "/{key}", RECORDS, "key_metrics",
        (_DATE, _number("peRatio", "P/E Ratio"), _number("marketCap", "Market Cap"),
         _number("dividendYield", "Dividend Yield"), _number("roe", "ROE")),
        sort_key="date",
    ),
    DatasetSpec(
        "ratios", "/v3/ratios", "/{key}", RECORDS, "ratios",
        (_DATE, _number("currentRatio", "Current Ratio"), _number("quickRatio", "Quick Ratio"),
         _number("debtEquityRatio", "Debt/Equity"), _number("returnOnEquity", "ROE")),
        sort_key="date",
    ),
    DatasetSpec(
        "growth", "/v3/financial-growth", "/{key}", RECORDS, "growth",
        (_DATE, _number("revenueGrowth", "Revenue Growth"),
         _number("netIncomeGrowth", "Net Income Growth"), _number("epsGrowth", "EPS Growth")),
        sort_key="date",
    ),
    DatasetSpec(
        "estimates", "/v4/analyst-estimates", "?symbol={key}", RECORDS, "estimates",
        (_DATE, _number("estimatedRevenueAvg", "Est. Revenue Avg"),
         _number("estimatedEpsAvg", "Est. EPS Avg")),
        sort_key="date",
    ),
    DatasetSpec(
        "earnings", "/v3/earning_calendar", "?symbol={key}", RECORDS, "earnings",
        (_DATE, _number("eps", "EPS"), _number("epsEstimated", "Est. EPS"),
         _number("revenue", "Revenue"), _number("revenueEstimated", "Est. Revenue")),
        sort_key="date",
    ),
    DatasetSpec(
        "targets", "/v4/price-target", "?symbol={key}", RECORDS, "targets",
        (_text("publishedDate", "Date"), _text("analystName", "Analyst"),
         _number("priceTarget", "Price Target"), _number("adjPriceTarget", "Adj Price Target")),
        sort_key="publishedDate",
    ),
    DatasetSpec(
        "grades", "/v3/grades", "/{key}", RECORDS, "grades",
        (_DATE, _text("gradingCompany", "Grader"), _text("grade", "Grade"),
         _text("previousGrade", "Prev Grade")),
        sort_key="date",
    ),
    DatasetSpec(
        "esg", "/v4/esg-environmental-social-governance-data", "?symbol={key}", RECORDS,
        "esg_data",
        (_DATE, _number("environmentalScore", "Environmental"), _number("socialScore", "Social"),
         _number("governanceScore", "Governance"), _number("total", "Total ESG")),
        sort_key="date",
    ),
    DatasetSpec(
        "economic", "/v3/economic", "?name={key}", RECORDS, "economic",
        (_DATE, _number("value", "Value")),
        sort_key="date", key_name="indicator", key_case="lower",
    ),
    DatasetSpec(
        "news", "/v3/stock_news", "?tickers={key}&limit=50", RECORDS, "news",
        (_text("publishedDate", "Date"), _text("title", "Title"), _text("site", "Source")),
        sort_key="publishedDate",
    ),
    DatasetSpec(
        "filings", "/v3/sec_filings", "/{key}", RECORDS, "filings",
        (_text("filingDate", "Date"), _text("type", "Type"), _text("title", "Title")),
        sort_key="filingDate",
    ),
    DatasetSpec(
        "insider", "/v4/insider-trading", "?symbol={key}", RECORDS, "insider_trading",
        (_text("transactionDate", "Date"), _text("insiderName", "Insider"),
         _text("transactionType", "Type"), _number("shares", "Shares"),
         _number("price", "Price")),
        sort_key="transactionDate",
    ),
    DatasetSpec(
        "holders", "/v3/institutional-holder", "/{key}", RECORDS, "holders",
        (_text("dateReported", "Date"), _text("holder", "Holder"), _number("shares", "Shares"),
         _number("value", "Value")),
        sort_key=None,
    ),
    DatasetSpec(
        "profile", "/v3/profile", "/{key}", RECORDS, "profile",
        (_text("companyName", "Company"), _text("industry", "Industry"),
         _text("sector", "Sector"), _text("website", "Website"), _number("price", "Price")),
        sort_key=None, top_n=None,
    ),
    DatasetSpec(
        "outlook", "/v4/company-outlook", "?symbol={key}", NESTED_OBJECT, "outlook",
        (_text("companyName", "Company"), _number("price", "Price"), _number("beta", "Beta"),
         _number("volAvg", "Avg Volume"), _number("mktCap", "Market Cap")),
        sort_key=None, top_n=None, member="profile",
    ),
    DatasetSpec(
        "revenue", "/v4/revenue-breakdown", "?symbol={key}", NESTED_MAP, "revenue_breakdown",
        (_text("period", "Period"), _text("segment", "Segment"), _number("value", "Revenue")),
        sort_key="period", member="breakdown", required_key="breakdown",
    ),
)

# The daily request budget over all paths together.
DAILY_LIMIT = 250

_BY_TYPE = {spec.data_type: spec for spec in CATALOG}


def spec_for(data_type: str) -> DatasetSpec:
    return _BY_TYPE[data_type]


def data_types_where(predicate) -> list[str]:
    """Data types whose spec satisfies ``predicate``, in catalogue order."""
    return [spec.data_type for spec in CATALOG if predicate(spec)]
