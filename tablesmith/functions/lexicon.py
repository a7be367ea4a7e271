"""Word lists, symbols and patterns that decide how dirty text is read."""

# Words read as booleans while cleaning (compared in upper case).
CLEAN_TRUE = ["예", "예요", "Y", "YES", "TRUE", "1"]
CLEAN_FALSE = ["아니오", "아니요", "N", "NO", "FALSE", "0"]

# Words counted as boolean by the profiler (compared in lower case).
PROFILE_BOOL = [
    "true", "t", "1", "y", "yes", "예", "ㅇ", "응",
    "false", "f", "0", "n", "no", "아니오", "아니요", "ㄴ", "ㄴㄴ",
]

# Currency marks per ISO code.
CURRENCY_MARKS = {
    "KRW": ["₩", "원", "KRW", "krw"],
    "USD": ["$", "USD", "usd"],
    "EUR": ["€", "EUR", "eur"],
    "JPY": ["¥", "JPY", "jpy"],
    "GBP": ["£", "GBP", "gbp"],
}

# Cell texts a CSV reader takes as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Columns whose time of day survives date cleaning.
KEEP_TIME_COLUMNS = ("업데이트일",)

# Date columns tried, in this order, when a month is asked for.
MONTH_SOURCES = ("주문일", "order_date", "date", "날짜")
MONTH_COLUMN = "월"

# Profiler patterns.
PROFILE_NUMERIC = r"^[\s+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*$"
PROFILE_CURRENCY = r"(?i)^(?:krw|₩|원)?\s*(?:[\d,]+(?:\.\d+)?)\s*(?:원)?$"
PROFILE_DATE_HINT = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2}|년|월|일|:"

# Keywords that tag a text with pivot rows, values, chart and filters.
KEYWORD_MAP = {
    "rows": {
        "월": ["월", "월별", "month"],
        "카테고리": ["카테고리", "카테고리별", "category", "cat"],
        "도시": ["도시", "도시별", "지역", "지역별", "city", "region"],
        "년": ["년", "연", "year"],
        "분기": ["분기", "quarter"],
    },
    "values": {
        "금액": {"keywords": ["매출", "금액", "합계", "sum", "sales", "amount"], "agg": "sum"},
        "수량": {"keywords": ["수량", "개수", "count", "quantity", "qty"], "agg": "sum"},
    },
    "chart": {
        "bar": ["막대", "막대차트", "bar", "bar chart", "column"],
        "line": ["라인", "선", "line", "line chart"],
        "pie": ["파이", "파이차트", "pie", "pie chart"],
    },
    "filters": {
        "도시": {
            "서울": ["서울", "seoul"],
            "부산": ["부산", "busan"],
            "대구": ["대구", "daegu"],
            "인천": ["인천", "incheon"],
            "광주": ["광주", "gwangju"],
        }
    },
}
