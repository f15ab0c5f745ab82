"""Canonical schemas of the tables and payloads."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
NTZ = T.TimestampNTZType()

LISTING_EXPORT = _struct(
    article_hash=STRING,
    article_title=STRING,
    category=STRING,
    publish_date=NTZ,
    article_body=STRING,
    raw_content=STRING,
    source_entity=STRING,
    article_link=STRING,
    generated_summary=STRING,
    negative_score=DOUBLE,
    importance_score=DOUBLE,
)

# The later inserts also carry a view count.
ARTICLE = T.StructType(LISTING_EXPORT.fields + [T.StructField("view_count", LONG, True)])

HEADER_IMAGE = _struct(article_hash=STRING, image_hash=STRING, s3_link=STRING)

HEADER_IMAGE_BYTES = _struct(
    article_hash=STRING, image_hash=STRING, article_image=T.BinaryType()
)

LISTING_ROW = _struct(
    title=STRING,
    link=STRING,
    date=STRING,
    image=STRING,
    raw_content=STRING,
    hash_id=STRING,
    category=STRING,
    entity=STRING,
)

TARGET = _struct(url=STRING, category=STRING, entity=STRING)

BODY_ROW = _struct(article_hash=STRING, article_body=STRING, raw_content=STRING)

VIEW_PAYLOAD = T.ArrayType(
    _struct(
        NotaId=LONG,
        Fecha=T.StructType(
            [T.StructField("$date", T.StructType([T.StructField("$numberLong", STRING)]))]
        ),
        Categorias=T.ArrayType(STRING),
        Tags=T.ArrayType(STRING),
        Autor=STRING,
        CoAutores=STRING,
        Publishers=T.ArrayType(STRING),
        Colaborators=STRING,
        Titulo=STRING,
        CatPrimary=STRING,
        CatSecondary=STRING,
        Visitas=LONG,
    )
)

# The one field the loader uses: a narrow schema parses several times faster.
VIEW_COUNT = T.ArrayType(_struct(Visitas=LONG))

SEARCH_PAYLOAD = _struct(news_results=T.ArrayType(_struct(title=STRING, link=STRING, date=STRING)))

METRIC = _struct(precision=DOUBLE, recall=DOUBLE, fmeasure=DOUBLE)
ROUGE = _struct(rouge1=METRIC, rougeL=METRIC)

EXPERIMENT = _struct(
    article_hash=STRING,
    n_chunks=T.IntegerType(),
    round=T.IntegerType(),
    chunks=T.ArrayType(STRING),
    summaries=T.ArrayType(STRING),
    scores=T.ArrayType(ROUGE),
)

METRIC_FRAME = _struct(
    chunksize=T.IntegerType(),
    meanf1_rouge1=DOUBLE,
    meanf1_rougeL=DOUBLE,
    meanprecision_rouge1=DOUBLE,
    meanprecision_rougeL=DOUBLE,
    meanrecall_rouge1=DOUBLE,
    meanrecall_rougeL=DOUBLE,
)
