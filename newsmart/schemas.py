"""Table schemas and the fixed values the operators share."""

from __future__ import annotations

# --- Fixed values: table layouts -------------------------------------------------------------

EXECUTIONS = (
    "execution_id STRING, timestamp TIMESTAMP, search_term STRING, filters MAP<STRING,STRING>, "
    "status STRING, end_time TIMESTAMP, scraped_at TIMESTAMP"
)
ARTICLES = (
    "article_id STRING, execution_id STRING, title STRING, url STRING, date STRING, source STRING, "
    "geodata STRING, image_url STRING, content_snippet STRING"
)
ARTICLES_CACHE = (
    "url STRING, states_json STRING, real_url STRING, image_path STRING, scraped_text STRING, title STRING, "
    "source STRING, date STRING, summary STRING, query STRING, ui_selected INT"
)
CHAT_HISTORY = (
    "id BIGINT, execution_id STRING, role STRING, encrypted_content STRING, timestamp TIMESTAMP"
)
DIM_DATE = "date_key DATE, date_str STRING, year INT, month INT, day INT"
DIM_SOURCE = "source_id BIGINT, source_name STRING"
DIM_ENTITIES = (
    "entity_id BIGINT, article_id STRING, execution_id STRING, entity_text STRING, entity_type STRING"
)
FACT_NEWS_METRICS = (
    "article_id STRING, execution_id STRING, date_key DATE, source_id BIGINT, word_count INT, "
    "entity_count INT, sentiment_score DECIMAL(5,2)"
)
DLQ_NEWS_METRICS = (
    "article_id STRING, execution_id STRING, raw_response STRING, error_reason STRING, timestamp TIMESTAMP"
)
JOB_PROGRESS = "run_id STRING, ts TIMESTAMP, progress_pct FLOAT, current_step STRING"

# Every leaf is text: the reader must tell "0.5" (accepted) from "abc" (rejected), which a DOUBLE
# schema would turn into the same NULL.
MODEL_ANSWER = (
    "results ARRAY<STRUCT<article_id STRING, sentiment_score STRING, summary STRING, "
    "entities_list ARRAY<STRUCT<entity_text STRING, entity_type STRING>>, locations_list ARRAY<STRING>>>"
)
FEED_ITEM = (
    "guid STRING, title STRING, link STRING, pubDate STRING, "
    "source STRUCT<_VALUE STRING, _url STRING>, description STRING"
)
GEOJSON = "features ARRAY<STRUCT<properties STRUCT<state_name STRING>>>"
COUNTRY_CONFIG = (
    "MAP<STRING, STRUCT<country_name STRING, center ARRAY<DOUBLE>, zoom INT, hl STRING, gl STRING, "
    "ceid STRING, llm_hints STRING>>"
)

# --- Fixed values: statuses and labels -------------------------------------------------------

RUN_STATUSES = [
    "SCRAPING", "SCRAPED", "PAUSED_BLOCKED", "QUEUED_FOR_ANALYSIS",
    "ANALYZING", "COMPLETED", "PARTIALLY_ANALYZED", "CANCELLED",
]
ONGOING_STATUSES = ["SCRAPING", "SCRAPED", "ANALYZING"]
OPEN_ENDED_STATUSES = ["STARTED", "STARTING", "SCRAPING", "QUEUED_FOR_ANALYSIS", "ANALYZING"]
JOB_STATUS_GROUPS = {
    "ACTIVE": ["QUEUED_FOR_ANALYSIS", "ANALYZING", "SCRAPING", "STARTED", "STARTING"],
    "READY": ["SCRAPED", "PARTIALLY_ANALYZED"],
    "COMPLETED": ["COMPLETED", "SUCCESS"],
}
NO_PLACE = "Sin localidad"
NO_TOP = "—"
DEFAULT_COUNTRY = "mx"
DEFAULT_QUERY = "noticias"
DEFAULT_STEP = "Starting..."
DEFAULT_SOURCE = "Desconocido"
# Texts of progress steps and the label shown for them.
STEP_LABELS = [
    (("Extrayendo texto", "Extracting text"), "Extracting text from articles..."),
    (("Iniciando análisis", "Starting LLM"), "Starting LLM analysis..."),
    (("Análisis completo", "Analysis complete"), "Analysis complete."),
    (("Buscando artículos", "Fetching discovery"), "Fetching news and metadata from Google..."),
    (("Extracción finalizada", "Extraction complete"), "Articles successfully collected."),
]
# Classes of progress messages: words as written, words in any case.
MESSAGE_CLASSES = [
    ("error", ("Error", "❌"), ("failed",)),
    ("complete", ("éxito",), ("exito", "complete", "completado", "success", "iniciado")),
]

# --- Fixed values: limits --------------------------------------------------------------------

MAX_ARTICLES = 100
DEFAULT_ARTICLES = 15
CANDIDATE_FACTOR = 3
DELTA_SIZE = 50
BATCH_SIZE = 5
SNIPPET_CHARS = 3000
QUESTION_CHARS = 600
MIN_ARTICLE_CHARS = 200
MIN_EXTRACT_CHARS = 100
SQL_ROWS = 50
CHAT_TURNS = 6
CHIPS_SHOWN = 3
RATE_WINDOW_SEC = 60
RATE_LIMIT = 10
DISCOVERY_RATE_LIMIT = 15

# --- Fixed values: patterns and word lists ---------------------------------------------------

BOILERPLATE_TAGS = ["script", "style", "nav", "footer", "header", "aside"]
NOISE_CLASS_TAGS = ["div", "ul", "li", "section"]
NOISE_WORDS = [
    "share", "social", "whatsapp", "twitter", "facebook", "linkedin", "email", "print", "newsletter", "ads",
]
# Places of a page that name its image: tag, attribute that tells the kind and its value, attribute with the address.
IMAGE_PLACES = [
    ("meta", "property", "og:image", "content"), ("meta", "name", "twitter:image", "content"),
    ("link", "rel", "image_src", "href"), ("img", None, None, "src"),
]
BAD_IMAGE_WORDS = [
    "logo", "icon", "avatar", "advertisement", "facebook", "twitter", "share", "banner", "placeholder",
]
INJECTION_PHRASES = [
    r"ignore\s+(previous|all|your)\s+(instructions?|prompts?|rules?)",
    r"reveal\s+(system|your)\s+prompt",
    r"forget\s+(everything|all|instructions?)",
    r"<script[\s\S]*?>",
    r"</script>",
    r"javascript:",
    r"system\s*prompt",
    r"jailbreak",
    r"DAN\b",
    r"do\s+anything\s+now",
]
QUANTITY_WORDS = [
    "cuantos?", "how many", "total", "count", "cantidad", "numero",
    "top", "mas frecuente", "most frequent", "rank", "tendencia",
    "por estado", "per state", "por fuente", "per source",
    "distribucion", "distribution", "timeline", "linea de tiempo",
    "cuando", "when", "fecha", "date", "promedio", "average", "ultimas?", "last", "scraper",
    "palabras? clave", "keywords?",
]
QUESTION_STOPWORDS = [
    "cual", "cuales", "cuanto", "cuantos", "cuanta", "cuantas",
    "como", "donde", "cuando", "sobre", "para", "pero", "porque",
    "este", "esta", "estos", "estas", "aquel", "aquella",
    "todo", "toda", "todos", "todas", "otro", "otra", "otros", "otras",
    "hacer", "hace", "tiene", "tienen", "haber", "habia",
    "dime", "dame", "muestra", "muestrame", "buscar", "busca",
    "noticia", "noticias", "articulo", "articulos", "informacion",
    "what", "which", "where", "when", "about", "that", "this", "these", "those",
    "from", "with", "have", "been", "were", "will", "would", "could", "should",
    "many", "much", "more", "most", "some", "such", "than", "then",
    "tell", "show", "find", "give", "look", "know",
    "news", "article", "articles", "information", "latest", "recent",
]
COLOUR_CLASSES = [(0.8, "#174ea6"), (0.6, "#1a73e8"), (0.4, "#4285f4"), (0.2, "#8ab4f8")]
COLOUR_LOWEST = "#c6dafc"
COLOUR_NONE = "#e8eaed"
COUNTRY_DEFAULTS = {
    "mx": {"country_name": "Mexico", "center": [23.6345, -102.5528], "zoom": 5, "hl": "es", "gl": "MX",
           "ceid": "MX:es", "llm_hints": "CDMX and DF are Ciudad de México, Edomex is Estado de México; México alone needs its context."},
    "usa": {"country_name": "United States", "center": [39.8283, -98.5795], "zoom": 4, "hl": "en", "gl": "US",
            "ceid": "US:en", "llm_hints": "Postal abbreviations such as TX or CA stand for the states."},
}
REGION_ALIASES = {"CDMX": "Ciudad de México", "DF": "Ciudad de México", "Edomex": "Estado de México"}

# Postal abbreviations of the states of the USA.
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
