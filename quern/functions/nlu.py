"""Question understanding: domain entities, intent rules, structured requests, applicant fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.shape import strip_ends

# Place and metric gazetteers.
KNOWN_LOCATIONS = [
    "telangana", "andhra pradesh", "karnataka", "maharashtra", "tamil nadu", "adilabad", "bhadradri kothagudem", "hyderabad",
    "jagtial", "jangaon", "jayashankar bhupalpally", "jogulamba gadwal", "kamareddy", "karimnagar", "khammam",
    "kumuram bheem asifabad", "mahabubabad", "mahabubnagar", "mancherial", "medak", "medchal malkajgiri", "mulugu",
    "nagarkurnool", "nalgonda", "narayanpet", "nirmal", "nizamabad", "peddapalli", "rajanna sircilla", "ranga reddy",
    "rangareddy", "sangareddy", "siddipet", "suryapet", "vikarabad", "wanaparthy", "warangal", "yadadri bhuvanagiri",
]
KNOWN_METRICS = [
    "rainfall", "precipitation", "gdp", "revenue", "default", "credit risk", "churn", "inflation", "unemployment", "density",
    "density index", "growth rate", "population", "loan amount", "credit score", "sales",
]


def whole_word_matches(text: Column, phrases: list[str]) -> Column:
    """Sorted distinct phrases of a short fixed list that occur as whole words.

    One pass with one pattern: at every word start the longest phrase is taken, and phrases
    that are its leading words are added, as they occur there too.
    """
    by_length = sorted(set(phrases), key=lambda p: (-len(p), p))
    pattern = r"(?U)\b(?=(" + "|".join(by_length) + r")\b)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    leading = {p: [q for q in by_length if p.startswith(q + " ")] for p in by_length}
    also = [F.when(F.array_contains(found, p), F.array(*[F.lit(q) for q in qs])) for p, qs in leading.items() if qs]
    if also:
        empty = F.array().cast("array<string>")
        found = F.concat(found, *[F.coalesce(a, empty) for a in also])
    return F.array_sort(F.array_distinct(found))


# Attribute patterns; the first non-empty group holds the number.
ATTRIBUTE_PATTERNS = {
    "age": (r"(\d+)\s*(?:-| )(?:year|yr)(?:s)?(?:-| )old|\bage\s*(?:of|:)?\s*(\d+)", 2),
    "income": (r"(?:income|earning|salary)(?:\s+of)?(?:\s+is)?(?:\s*:)?\s*\$?([\d,]+)", 1),
    "credit_score": (r"(?:credit score|score)(?:\s+of)?(?:\s*:)?\s*(\d{3})\b", 1),
    "loan_amount": (r"(?:loan amount|loan|borrowing)(?:\s+of)?(?:\s*:)?\s*\$?([\d,]+)", 1),
    "years_employed": (r"(\d+)\s*(?:years?|yrs?)\s*(?:employed|experience)|(?:employed|worked)\s*(?:for)?\s*(\d+)\s*(?:years?|yrs?)", 2),
}


def first_number(text: Column, pattern: str, groups: int) -> Column:
    parts = [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in range(1, groups + 1)]
    return F.replace(F.coalesce(*parts), F.lit(","), F.lit("")).try_cast("double")


def domain_entities(query: Column) -> Column:
    """Struct of locations, metrics, dates and numeric applicant attributes found in a question."""
    text = strip_ends(query)
    low = F.lower(text)
    days = F.regexp_extract_all(text, F.lit(r"(?U)\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    years = F.regexp_extract_all(text, F.lit(r"(?U)\b(20[1-3][0-9])\b"), F.lit(1))
    features = F.struct(*[first_number(low, p, g).alias(n) for n, (p, g) in ATTRIBUTE_PATTERNS.items()])
    return F.struct(
        F.transform(whole_word_matches(low, KNOWN_LOCATIONS), F.initcap).alias("locations"),
        whole_word_matches(low, KNOWN_METRICS).alias("metrics"),
        F.array_sort(F.array_distinct(F.concat(days, years))).alias("dates"),
        features.alias("features"),
    )


# Intent keywords in order of precedence, confidences and routes.
INTENT_RULES = [
    ("GIS_VIEW", 0.85, ["boundary", "map", "gis", "district", "spatial", "telangana", "adilabad", "coordinates", "tier"]),
    ("PREDICTION", 0.85, ["predict", "forecast", "estimate", "churn", "credit score", "loan amount"]),
    ("DATA_METRIC", 0.80, ["metric", "rainfall", "revenue", "gdp", "inflation", "statistics", "count", "kpi"]),
    ("FAQ", 0.80, ["what is", "explain", "who authored", "describe", "how does", "summarize"]),
]
UNKNOWN = ("UNKNOWN_INTENT", 0.30)
ROUTES = {"GIS_VIEW": "gis", "PREDICTION": "ml", "DATA_METRIC": "rag", "FAQ": "rag", "UNKNOWN_INTENT": "unknown"}


def intent(query: Column) -> Column:
    """Struct of intent, confidence and route by keyword rules; blank text has confidence 0."""
    text = F.lower(F.coalesce(query, F.lit("")))
    name, sure = F.lit(UNKNOWN[0]), F.lit(UNKNOWN[1])
    for label, confidence, keywords in reversed(INTENT_RULES):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(text, F.lit(k))
        name, sure = F.when(hit, label).otherwise(name), F.when(hit, confidence).otherwise(sure)
    blank = strip_ends(text) == ""
    name, sure = F.when(blank, UNKNOWN[0]).otherwise(name), F.when(blank, 0.0).otherwise(sure)
    return F.struct(name.alias("intent"), sure.alias("confidence"), route(name).alias("route"))


def route(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit("unknown"))


def confident_intent(labels: list[str], probability: Column, floor: float = 0.40) -> Column:
    """Best class of a probability array, or unknown below the floor."""
    best = F.array_max(probability)
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(probability, best).cast("int"))
    return F.when(best < floor, F.lit(UNKNOWN[0])).otherwise(label)


# Defaults of a scoring request.
REQUEST_DEFAULTS = {"age": 35.0, "income": 50000.0, "credit_score": 680.0, "loan_amount": 10000.0, "years_employed": 5.0}
REQUEST_TEXTS = {"education": "bachelor", "employment_status": "employed", "marital_status": "single", "housing_type": "rent"}
DEFAULT_DATE = "2026-09-21"
UNRECOGNIZED = "Query could not be mapped to an actionable domain. Please formulate an economic, spatial, or prediction query."


# Services and endpoints.
SERVICES = {
    "GIS_VIEW": "GIS_SPATIAL_SERVICE", "PREDICTION": "ML_INFERENCE_SERVICE", "DATA_METRIC": "BACKEND_DATA_SERVICE", "FAQ": "RAG_KNOWLEDGE_SERVICE",
    "UNKNOWN_INTENT": "FALLBACK_HANDLER",
}
PLACE_ENDPOINT, TIER_ENDPOINT = "/api/v1/spatial/query", "/api/v1/spatial/boundaries/1"
SCORING_ENDPOINT, DATA_ENDPOINT, QUESTION_ENDPOINT = "/predict", "/process", "/api/v1/ai/query"
HOME_STATE, METRIC_PROFILE, ANSWER_CHUNKS = "Telangana", "company_financials", 3


def structured_request(query: Column, intent_name: Column, found: Column) -> Column:
    """JSON request for the service that should answer a question."""
    place = F.try_element_at(found["locations"], F.lit(1))

    def request(label: str, endpoint: str, method: str, name: str, body: Column) -> Column:
        schema = F.struct(F.lit(endpoint).alias("endpoint"), F.lit(method).alias("method"), body.alias(name))
        return F.to_json(F.struct(F.lit(SERVICES[label]).alias("target_service"), schema.alias("request_schema")))

    by_place = F.struct(place.alias("q"), F.lit(HOME_STATE).alias("state"))
    by_tier = F.struct(F.lit(1).alias("tier"))
    spatial = F.when(place.isNotNull(), request("GIS_VIEW", PLACE_ENDPOINT, "GET", "params", by_place)).otherwise(request("GIS_VIEW", TIER_ENDPOINT, "GET", "params", by_tier))
    fields = [F.coalesce(found["features"][n], F.lit(v)).alias(n) for n, v in REQUEST_DEFAULTS.items()]
    fields += [F.lit(v).alias(n) for n, v in REQUEST_TEXTS.items()]
    fields.append(F.coalesce(F.try_element_at(found["dates"], F.lit(1)), F.lit(DEFAULT_DATE)).alias("application_date"))
    filters = F.struct(found["locations"].alias("locations"), found["metrics"].alias("metrics"), found["dates"].alias("dates"))
    metric = F.struct(F.lit(METRIC_PROFILE).alias("profile"), filters.alias("filters"))
    asked = F.struct(query.alias("query"), F.lit(ANSWER_CHUNKS).alias("k"))
    fallback = F.struct(F.lit("unrecognized").alias("status"), F.lit(UNRECOGNIZED).alias("message"))
    return (
        F.when(intent_name == "GIS_VIEW", spatial)
        .when(intent_name == "PREDICTION", request("PREDICTION", SCORING_ENDPOINT, "POST", "payload", F.struct(*fields)))
        .when(intent_name == "DATA_METRIC", request("DATA_METRIC", DATA_ENDPOINT, "POST", "payload", metric))
        .when(intent_name == "FAQ", request("FAQ", QUESTION_ENDPOINT, "POST", "payload", asked))
        .otherwise(F.to_json(F.struct(F.lit(SERVICES["UNKNOWN_INTENT"]).alias("target_service"), fallback.alias("request_schema"))))
    )


# Applicant field patterns, category words in order of precedence, defaults.
FIELD_PATTERNS = {
    "age": r"age\s*(?:is|:)?\s*(\d{1,3})",
    "income": r"(?:income|salary|pay)\s*(?:is|:)?\s*\$?([0-9,]+)",
    "loan_amount": r"(?:loan|amount)\s*(?:is|:)?\s*\$?([0-9,]+)",
    "years_employed": r"(\d+)\s*(?:years|yrs)\s*(?:employed)?",
}
CATEGORY_WORDS = [
    (["bachelor", "ba"], "bachelor"), (["master", "ms"], "master"), (["phd"], "phd"), (["employed"], "employed"),
    (["self-employed", "self employed"], "self-employed"), (["unemployed"], "unemployed"), (["married"], "married"), (["single"], "single"),
]
NUMBER_FIELDS = ["age", "income", "credit_score", "loan_amount", "years_employed"]
TEXT_FIELDS = ["education", "employment_status", "marital_status", "housing_type", "application_date"]


def applicant_fields(query: Column) -> Column:
    """Struct of applicant fields read from free text; fields not found are missing.

    A numeric field without its own pattern match takes the first number of the text.
    """
    low = F.lower(query)
    numbers = F.regexp_extract_all(query, F.lit(r"(?U)\b(\d{1,3}(?:,\d{3})*)\b"), F.lit(1))
    any_number = F.replace(F.try_element_at(numbers, F.lit(1)), F.lit(","), F.lit("")).try_cast("double")
    parts = []
    for name in NUMBER_FIELDS:
        if name == "credit_score":
            value = F.nullif(F.regexp_extract(query, r"(?U)\b(\d{3})\b", 1), F.lit("")).try_cast("double")
        else:
            value = F.coalesce(first_number(low, FIELD_PATTERNS[name], 1), any_number)
        parts.append(value.alias(name))
    word = F.lit(None).cast("string")
    for spellings, value in reversed(CATEGORY_WORDS):
        hit = F.lit(False)
        for s in spellings:
            hit = hit | F.contains(low, F.lit(s))
        word = F.when(hit, value).otherwise(word)
    parts += [word.alias(n) for n in TEXT_FIELDS]
    return F.struct(*parts)


def missing_fields(found: Column) -> Column:
    return F.array_compact(F.array(*[F.when(found[n].isNull(), F.lit(n)) for n in NUMBER_FIELDS + TEXT_FIELDS]))


def filled_fields(found: Column, today: Column) -> Column:
    """Defaults for the missing fields: 0 for numbers, common categories, today's date."""
    parts = [F.coalesce(found[n], F.lit(0.0)).alias(n) for n in NUMBER_FIELDS]
    parts += [F.coalesce(found[n], today if n == "application_date" else F.lit(REQUEST_TEXTS[n])).alias(n) for n in TEXT_FIELDS]
    return F.struct(*parts)
