"""Word lists, weights, limits and patterns the results depend on."""

from __future__ import annotations

# Look-back windows, in hours.
WINDOW_HOURS = {"6h": 6, "24h": 24, "3d": 72, "7d": 168}

# Timeline bucket size per look-back window, in seconds.
TIMELINE_BUCKET_SECONDS = {"6h": 1800, "24h": 7200, "3d": 21600, "7d": 43200}

# News page size per look-back window.
NEWS_LIMIT = {"6h": 50, "24h": 50, "3d": 200, "7d": 200}
MAX_NEWS_LIMIT = 200

# Ranking.
BASELINE_HOURS = 168
BOARD_SIZE = 10
SEARCH_SIZE = 10
PARTIAL_MATCHES_PER_TERM = 5
SPIKE_Z = 2.0
SPIKE_BOOST = 1.3
UNCOUNTED_SOURCES = ("stocktwits",)
GLOBAL_BOARD = "global"

# Near-duplicate detection.
NUM_PERM = 128
SHINGLE_WORDS = 3
NEAR_DUP_THRESHOLD = 0.85
NEAR_DUP_HOURS = 24

# Items that a capped feed keeps, and days that the store keeps.
RSS_ITEMS_PER_FEED = 15
RETENTION_DAYS = 7

# Entity labels that name an organisation or a ticker.
ENTITY_LABELS = ("ORG", "TICKER", "B-ORG", "I-ORG")

# Where a model's answer holds its JSON, in the order of trial.
FENCED_ANSWER = r"(?s)```(?:json)?\s*(.*?)\s*```"
BRACED_ANSWER = r"(?s)(\{.*\})"

# Authority weight per source; anything else weighs 1.0.
SOURCE_WEIGHTS = {
    "alphavantage": 1.00,
    "polygon": 0.90,
    "finnhub_general": 0.90,
    "finnhub_company": 0.90,
    "finnhub_insider": 0.90,
    "yahoo_rss": 0.85,
    "newsapi": 0.80,
    "googlenews_rss": 0.80,
    "gdelt": 0.75,
    "stocktwits": 0.30,
    "twitter": 0.30,
    "reddit": 0.20,
}
DEFAULT_WEIGHT = 1.0

# Query keyword -> sector, in match order.  Health keywords use
# the spelling of the ticker dimension ("Healthcare").
SECTOR_KEYWORDS = {
    "ai": "Technology",
    "artificial intelligence": "Technology",
    "tech": "Technology",
    "technology": "Technology",
    "software": "Technology",
    "semiconductor": "Technology",
    "chip": "Technology",
    "energy": "Energy",
    "oil": "Energy",
    "gas": "Energy",
    "renewable": "Energy",
    "solar": "Energy",
    "health": "Healthcare",
    "healthcare": "Healthcare",
    "pharma": "Healthcare",
    "biotech": "Healthcare",
    "medical": "Healthcare",
    "drug": "Healthcare",
    "finance": "Financials",
    "financial": "Financials",
    "bank": "Financials",
    "banking": "Financials",
    "insurance": "Financials",
    "consumer": "Consumer Discretionary",
    "retail": "Consumer Discretionary",
    "ecommerce": "Consumer Discretionary",
    "industrial": "Industrials",
    "aerospace": "Industrials",
    "defense": "Industrials",
    "materials": "Materials",
    "mining": "Materials",
    "utilities": "Utilities",
    "telecom": "Communication Services",
    "communication": "Communication Services",
    "media": "Communication Services",
    "real estate": "Real Estate",
    "reit": "Real Estate",
}

# Words that mark a news question.
NEWS_WORDS = ("news", "report", "earnings", "announce", "beat", "miss")

# Upper-case words of a search query that are not tickers.
QUERY_STOPWORDS = tuple(
    """
    A I AI AN AS AT BE BY DO GO IF IN IS IT ME MY NO OF ON OR SO TO UP US WE
    THE AND FOR GET HAS NOT BUT ARE WAS FROM THAT THIS WITH WILL HAVE THEY
    BEEN WERE INTO THAN THEN WHEN WHICH WHO HOW WHY WHAT ALL ANY CAN MAY ETF
    EPS IPO CEO CFO COO SEC FED GDP USA USD EUR GBP
    """.split()
)

# Upper-case words of an article that are not tickers.
ARTICLE_STOPWORDS = tuple(
    """
    A I AM AN AS AT BE BY DO GO IF IN IS IT ME MY NO OF ON OR SO TO UP US
    WE AND ARE FOR GET HAS HAD HIM HIS HOW ITS LET MAY NEW NOT NOW OFF OUR
    OUT OWN SAY SEE SET SHE THE TOO TWO WAS WAY WHO WHY YET YOU ALL BIG CAN
    DID HER ILL OLD ONE OWE PUT RAN RUN SIT SIX TEN YES YOUR BEEN BOTH CALL
    CAME COME DOES EACH EVEN FROM GAVE GIVE GOES GONE GOOD HAVE HELP HERE
    HIGH INTO JUST KEEP KIND KNOW LAST LESS LIKE LONG LOOK MADE MAKE MANY
    MORE MOST MOVE MUCH MUST NEED NEXT ONLY OPEN OVER PART PAST PLAN PLAY
    READ REAL SAID SAME SEEM SHOW SIDE SOME SOON STAY SUCH TAKE TELL THAN
    THAT THEM THEN THEY THIS THUS TIME TOLD TOOK TURN USED VERY WANT WELL
    WENT WERE WHAT WHEN WITH WORD WORK YEAR IPO ETF CEO CFO COO CTO SEC NYSE
    NASDAQ GDP FED IMF EUR USD GBP YEN OTC ALT
    """.split()
)

# Company-name words that carry no identity (regex fragments).
LEGAL_SUFFIXES = (
    r"Inc\.?", r"Corp\.?", r"Co\.?", r"Ltd\.?", "LLC", "plc", "Group",
    "Company", "Corporation", "Incorporated", "Limited", "Holdings?",
    "Laboratories?", "Systems?", "Technologies?", "Platforms?", "Partners?",
    "Bancorp", "Bancshares?", "Financial", "Services?", "Pharmaceuticals?",
    "Energy", "Motors?", "Airlines?", "Networks?", "Solutions?",
    "Enterprises?", "Industries?", "International", "Global", "Worldwide",
    "Capital", "Ventures?", "Associates?", "The",
)
MIN_KEYWORD_CHARS = 4

# Company-name words too common to identify a company.
KEYWORD_BLOCKLIST = (
    "linde", "deere", "ford", "general", "advanced", "american", "next",
    "united", "home", "procter", "gamble", "walt", "morgan", "bank", "visa",
)

# Theme-code prefixes of business and finance news.
FINANCE_THEMES = (
    "ECON_STOCKMARKET", "ECON_TRADE", "ECON_CURRENCY", "ECON_BANKRUPTCY",
    "ECON_INFLATION", "ECON_INTEREST", "ECON_INVESTMENT", "ECON_RATECHANGE",
    "ECON_IPO", "ECON_TAXATION", "ECON_ENTREPRENEURSHIP", "ECON_REFORM",
    "BUS_MARKET", "BUS_EARNINGS", "BUS_ACQUISITION", "BUS_MERGER", "BUS_IPO",
    "BUS_LAYOFFS", "COMPANY_BANKRUPTCY",
    "CRISISLEX_CRISISLEXR4_BUSINESSAFFAIRS",
)

# Sentiment tag of a social message.
MESSAGE_TAGS = {"Bullish": 1.0, "Bearish": -1.0}

# Positions (0-based) in a 27-column GKG row.
GKG_DATE, GKG_URL, GKG_THEMES_V1, GKG_THEMES_V2 = 1, 4, 7, 8
GKG_QUOTATIONS, GKG_EXTRAS, GKG_MIN_COLUMNS = 22, 26, 27

# Patterns.
OUTLET_SUFFIX = r"\s+-\s+[^-]+$"
PAGE_TITLE = r"(?s)<PAGE_TITLE>(.*?)</PAGE_TITLE>"
QUERY_TICKER = r"\$?([A-Z]{1,5})\b"

# Sources whose items name their tickers; the others are scanned.
NAMED_TICKER_SOURCES = (
    "alphavantage", "finnhub_general", "finnhub_company", "finnhub_insider", "yahoo_rss", "stocktwits",
)
# Of these, sources that are scanned when they name none.
SCAN_FALLBACK_SOURCES = ("finnhub_general",)
# Sources that bring their own sentiment and skip the scorer.
PRESCORED_SOURCES = ("finnhub_insider", "stocktwits")
