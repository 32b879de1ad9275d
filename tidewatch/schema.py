"""Table and record schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


STRING, BIGINT, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
BOOLEAN, TIMESTAMP, DATE, FLOAT = T.BooleanType(), T.TimestampType(), T.DateType(), T.FloatType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TICKERS = struct(symbol=STRING, sector=STRING, company_name=STRING)

ARTICLES = struct(
    id=BIGINT, source=STRING, title=STRING, content=STRING, url=STRING, timestamp=TIMESTAMP, created_at=TIMESTAMP,
    minhash_signature=T.ArrayType(INT), embedding=T.ArrayType(FLOAT), dt=DATE,
)

MENTIONS = struct(
    id=BIGINT, ticker=STRING, article_id=BIGINT, sentiment=DOUBLE, source_weight=DOUBLE, llm_summary=STRING,
    created_at=TIMESTAMP, dt=DATE,
)

# Interchange record every normaliser produces.
NORMALIZED_ITEM = struct(
    id=STRING, source=STRING, title=STRING, content=STRING, timestamp=TIMESTAMP, url=STRING,
    tickers=T.ArrayType(STRING), sentiment=DOUBLE,
)

ANALYSIS = struct(ticker=STRING, is_relevant=BOOLEAN, sentiment=DOUBLE, summary=STRING)

# Raw payloads, one JSON document per record.
NEWSAPI = struct(publishedAt=STRING, title=STRING, content=STRING, description=STRING, url=STRING)
ALPHAVANTAGE = struct(
    title=STRING, summary=STRING, url=STRING, time_published=STRING, overall_sentiment_score=STRING,
    ticker_sentiment=T.ArrayType(struct(ticker=STRING, ticker_sentiment_score=STRING)),
)
POLYGON = struct(
    id=STRING, published_utc=STRING, title=STRING, description=STRING, article_url=STRING, tickers=T.ArrayType(STRING)
)
TWEET = struct(id=STRING, text=STRING, created_at=STRING)
REDDIT = struct(id=STRING, title=STRING, selftext=STRING, created_utc=DOUBLE, permalink=STRING)
FINNHUB_NEWS = struct(headline=STRING, summary=STRING, url=STRING, datetime=STRING, related=STRING, symbol=STRING)
INSIDER = struct(symbol=STRING, mspr=DOUBLE, change=DOUBLE, year=INT, month=INT)
STOCKTWITS = struct(
    id=STRING, body=STRING, created_at=STRING, symbol=STRING, pos=INT,
    entities=struct(basic=STRING, sentiment=struct(basic=STRING)),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the columns of a schema, with its types; absent ones are NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])
