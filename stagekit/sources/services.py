"""Remote services as stages: where each one is, what it is sent and what comes back.

A service is an entry of ``SERVICES``: path, how the body is made, the schema of the answer, and whether the
answer has to be asked for. Parameters are values or columns (``F.col``); a row whose required parameter
is null is not sent. Nothing is computed here, so a service is configuration of ``sources.http``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagekit.plans.session import fresh
from stagekit.sources import http

DOCUMENTS = "struct<documents:array<struct<id:string,{}>>,errors:array<struct<id:string,error:string>>>"
BOX = "struct<left:int,top:int,width:int,height:int>"


@dataclass
class Service:
    """``body``: ``documents`` (a text list), ``texts`` (an array of texts), ``url`` (an address or bytes), or ``fields``
    (the parameters as one object); ``query``: parameters that go into the address."""

    path: str
    body: str
    schema: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    query: tuple[str, ...] = ()
    method: str = "POST"
    waits: bool = False


_TEXT = ("text",)
SERVICES: dict[str, Service] = {
    # texts
    "sentiment": Service("/text/analytics/v3.0/sentiment", "documents", DOCUMENTS.format("sentiment:string,confidenceScores:struct<positive:double,neutral:double,negative:double>"), _TEXT, ("language",)),
    "sentiment_v2": Service("/text/analytics/v2.0/sentiment", "documents", DOCUMENTS.format("score:double"), _TEXT, ("language",)),
    "key_phrases": Service("/text/analytics/v3.0/keyPhrases", "documents", DOCUMENTS.format("keyPhrases:array<string>"), _TEXT, ("language",)),
    "key_phrases_v2": Service("/text/analytics/v2.0/keyPhrases", "documents", DOCUMENTS.format("keyPhrases:array<string>"), _TEXT, ("language",)),
    "named_entities": Service("/text/analytics/v3.0/entities/recognition/general", "documents", DOCUMENTS.format("entities:array<struct<text:string,category:string,offset:int,length:int,confidenceScore:double>>"), _TEXT, ("language",)),
    "named_entities_v2": Service("/text/analytics/v2.1/entities", "documents", DOCUMENTS.format("entities:array<struct<name:string,type:string>>"), _TEXT, ("language",)),
    "linked_entities": Service("/text/analytics/v3.0/entities/linking", "documents", DOCUMENTS.format("entities:array<struct<name:string,url:string,dataSource:string>>"), _TEXT, ("language",)),
    "linked_entities_v2": Service("/text/analytics/v2.0/entities", "documents", DOCUMENTS.format("entities:array<struct<name:string,wikipediaUrl:string>>"), _TEXT, ("language",)),
    "language": Service("/text/analytics/v3.0/languages", "documents", DOCUMENTS.format("detectedLanguage:struct<name:string,iso6391Name:string,confidenceScore:double>"), _TEXT),
    "language_v2": Service("/text/analytics/v2.0/languages", "documents", DOCUMENTS.format("detectedLanguages:array<struct<name:string,iso6391Name:string,score:double>>"), _TEXT),
    # translation
    "translate": Service("/translate", "texts", "array<struct<translations:array<struct<text:string,to:string>>>>", _TEXT, (), ("to", "from", "textType", "category", "profanityAction")),
    "transliterate": Service("/transliterate", "texts", "array<struct<text:string,script:string>>", _TEXT, (), ("language", "fromScript", "toScript")),
    "detect": Service("/detect", "texts", "array<struct<language:string,score:double,isTranslationSupported:boolean>>", _TEXT),
    "break_sentence": Service("/breaksentence", "texts", "array<struct<sentLen:array<int>>>", _TEXT, (), ("language", "script")),
    "dictionary_lookup": Service("/dictionary/lookup", "texts", "array<struct<normalizedSource:string,translations:array<struct<normalizedTarget:string,posTag:string,confidence:double>>>>", _TEXT, (), ("from", "to")),
    "dictionary_examples": Service("/dictionary/examples", "fields", "array<struct<normalizedSource:string,normalizedTarget:string,examples:array<struct<sourcePrefix:string,sourceTerm:string,sourceSuffix:string>>>>", ("text", "translation"), (), ("from", "to")),
    "translate_documents": Service("/translator/text/batch/v1.0/batches", "fields", "struct<id:string,status:string>", ("inputs",), (), (), "POST", True),
    # images
    "ocr": Service("/vision/v2.0/ocr", "url", "struct<language:string,regions:array<struct<boundingBox:string,lines:array<struct<words:array<struct<text:string,boundingBox:string>>>>>>>", ("image",), (), ("language", "detectOrientation")),
    "recognize_text": Service("/vision/v2.0/recognizeText", "url", "struct<status:string,recognitionResult:struct<lines:array<struct<text:string>>>>", ("image",), (), ("mode",), "POST", True),
    "read": Service("/vision/v3.1/read/analyze", "url", "struct<status:string,analyzeResult:struct<readResults:array<struct<page:int,lines:array<struct<text:string>>>>>>", ("image",), (), ("language",), "POST", True),
    "thumbnail": Service("/vision/v2.0/generateThumbnail", "url", "binary", ("image",), (), ("width", "height", "smartCropping")),
    "analyze_image": Service("/vision/v2.0/analyze", "url", "struct<categories:array<struct<name:string,score:double>>,tags:array<struct<name:string,confidence:double>>,description:struct<captions:array<struct<text:string,confidence:double>>>>", ("image",), (), ("visualFeatures", "details", "language")),
    "domain_content": Service("/vision/v2.0/models/celebrities/analyze", "url", "struct<result:map<string,string>>", ("image",)),
    "tag_image": Service("/vision/v2.0/tag", "url", "struct<tags:array<struct<name:string,confidence:double>>>", ("image",), (), ("language",)),
    "describe_image": Service("/vision/v2.0/describe", "url", "struct<description:struct<tags:array<string>,captions:array<struct<text:string,confidence:double>>>>", ("image",), (), ("maxCandidates", "language")),
    # faces
    "detect_face": Service("/face/v1.0/detect", "url", f"array<struct<faceId:string,faceRectangle:{BOX}>>", ("image",), (), ("returnFaceId", "returnFaceLandmarks", "returnFaceAttributes")),
    "similar_faces": Service("/face/v1.0/findsimilars", "fields", "array<struct<faceId:string,persistedFaceId:string,confidence:double>>", ("faceId",), ("faceListId", "largeFaceListId", "faceIds", "maxNumOfCandidatesReturned", "mode")),
    "group_faces": Service("/face/v1.0/group", "fields", "struct<groups:array<array<string>>,messyGroup:array<string>>", ("faceIds",)),
    "identify_faces": Service("/face/v1.0/identify", "fields", "array<struct<faceId:string,candidates:array<struct<personId:string,confidence:double>>>>", ("faceIds",), ("personGroupId", "largePersonGroupId", "maxNumOfCandidatesReturned", "confidenceThreshold")),
    "verify_faces": Service("/face/v1.0/verify", "fields", "struct<isIdentical:boolean,confidence:double>", (), ("faceId1", "faceId2", "faceId", "personId", "personGroupId")),
    # forms
    **{
        name: Service(f"/formrecognizer/v2.1/{path}", "url", "struct<status:string,analyzeResult:struct<readResults:array<struct<page:int,lines:array<struct<text:string>>>>,documentResults:array<struct<docType:string,fields:map<string,struct<type:string,valueString:string,text:string>>>>>>", ("image",), (), ("includeTextDetails", "pages", "locale"), "POST", True)
        for name, path in (("analyze_layout", "layout/analyze"), ("analyze_receipts", "prebuilt/receipt/analyze"), ("analyze_business_cards", "prebuilt/businessCard/analyze"),
                           ("analyze_invoices", "prebuilt/invoice/analyze"), ("analyze_id_documents", "prebuilt/idDocument/analyze"), ("analyze_custom_model", "custom/models/{modelId}/analyze"))
    },
    "list_custom_models": Service("/formrecognizer/v2.1/custom/models", "none", "struct<modelList:array<struct<modelId:string,status:string>>>", (), (), ("op",), "GET"),
    "get_custom_model": Service("/formrecognizer/v2.1/custom/models/{modelId}", "none", "struct<modelInfo:struct<modelId:string,status:string>>", (), (), ("includeKeys",), "GET"),
    # series
    "last_anomaly": Service("/anomalydetector/v1.0/timeseries/last/detect", "fields", "struct<isAnomaly:boolean,expectedValue:double,upperMargin:double,lowerMargin:double,period:int>", ("series", "granularity"), ("maxAnomalyRatio", "sensitivity", "customInterval", "period")),
    "entire_anomaly": Service("/anomalydetector/v1.0/timeseries/entire/detect", "fields", "struct<isAnomaly:array<boolean>,expectedValues:array<double>,upperMargins:array<double>,lowerMargins:array<double>,period:int>", ("series", "granularity"), ("maxAnomalyRatio", "sensitivity", "customInterval", "period")),
    # speech and search
    "speech_to_text": Service("/speech/recognition/conversation/cognitiveservices/v1", "url", "struct<RecognitionStatus:string,Offset:bigint,Duration:bigint,DisplayText:string>", ("audio",), (), ("language", "format", "profanity")),
    "image_search": Service("/v7.0/images/search", "none", "struct<value:array<struct<name:string,contentUrl:string,thumbnailUrl:string>>,totalEstimatedMatches:bigint>", ("q",), (), ("q", "count", "offset", "imageType", "mkt"), "GET"),
}


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _address(base: str, service: Service, values: dict[str, Column]) -> Column:
    out = F.lit(base.rstrip("/") + service.path)
    for name, x in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(x.cast("string"), F.lit("")))
    asked = [F.concat(F.lit(f"{q}="), F.url_encode(values[q].cast("string"))) for q in service.query if q in values]
    return F.concat(out, F.lit("?"), F.concat_ws("&", *asked)) if asked else out


def call_service(
    df: DataFrame, name: str, base: str, output_col: str, error_col: str = "errors", key: str | Column | None = None, concurrency: int = 1, timeout: float = 60.0,
    handler: Callable | None = None, key_header: str = "Ocp-Apim-Subscription-Key", **parameters,
) -> DataFrame:
    """``df`` with what service ``name`` at ``base`` answers, and the body and status of other answers in ``error_col``."""
    service = SERVICES[name]
    missing = [r for r in service.required if r not in parameters]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    values = {k: _value(v) for k, v in parameters.items()}
    headers: dict = {key_header: key} if key is not None else {}
    body = None
    if service.body == "documents":
        one = F.struct(F.lit("0").alias("id"), F.coalesce(values.get("language", F.lit("en")), F.lit("en")).alias("language"), values["text"].alias("text"))
        body = F.to_json(F.struct(F.array(one).alias("documents")))
    elif service.body == "texts":
        body = F.to_json(F.array(F.struct(values["text"].alias("Text"))))
    elif service.body == "url":
        (sent,) = service.required
        raw = df.select(values[sent].alias("x")).schema["x"].dataType.typeName() == "binary"
        body = values[sent] if raw else F.to_json(F.struct(values[sent].alias("url")))
        headers["Content-type"] = "application/octet-stream" if raw else "application/json"
    elif service.body == "fields":
        wanted = [k for k in (*service.required, *service.optional) if k in values and k not in service.query]
        body = F.to_json(F.struct(*[values[k].alias(k) for k in wanted]))
    if body is not None and service.body != "url":
        headers["Content-type"] = "application/json"
    there = F.lit(True)
    for r in service.required:
        there = there & values[r].isNotNull()
    sent, got = fresh([*df.columns, output_col, error_col], "request", "response")
    asked = F.when(there, http.request(_address(base, service, values), body, service.method, headers))
    handler = handler or (http.polling() if service.waits else http.advanced)
    out = http.send(df.withColumn(sent, asked), sent, got, concurrency, timeout, handler)
    fine = F.col(got)["code"].isin(200, 201, 202)
    answer = F.col(got)["body"] if service.schema == "binary" else http.json_response(F.col(got), service.schema)
    trouble = F.struct(http.body_text(F.col(got)).alias("response"), F.struct(F.col(got)["code"].alias("code"), F.col(got)["reason"].alias("reason")).alias("status"))
    return out.withColumn(output_col, F.when(fine, answer)).withColumn(error_col, F.when(F.col(got).isNotNull() & ~fine, trouble)).drop(sent, got)


def detect_series_anomalies(df: DataFrame, base: str, group_col: str, time_col: str, value_col: str, output_col: str, granularity: str = "monthly", **options) -> DataFrame:
    """Rows of a group as one series in the order of time, judged by ``entire_anomaly``, and what it says of each row."""
    point = F.struct(F.date_format(F.col(f"`{time_col}`"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col(f"`{value_col}`").cast("double").alias("value"))
    series = df.groupBy(group_col).agg(F.array_sort(F.collect_list(point)).alias("series"))
    judged = call_service(series, "entire_anomaly", base, output_col, series=F.col("series"), granularity=granularity, **options)
    found = F.col(output_col)
    each = F.arrays_zip(found["isAnomaly"].alias("isAnomaly"), found["expectedValues"].alias("expectedValue"), found["upperMargins"].alias("upperMargin"), found["lowerMargins"].alias("lowerMargin"))
    at = judged.select(group_col, "errors", F.posexplode_outer(each).alias("place", "one"))
    place = F.row_number().over(Window.partitionBy(group_col).orderBy(F.date_format(F.col(f"`{time_col}`"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col(f"`{value_col}`").cast("double"))) - 1
    rows = df.withColumn("place", place)
    return rows.join(at.select(group_col, F.col("place"), F.col("one").alias(output_col), "errors"), [group_col, "place"], "left").drop("place")


def flatten_forms(df: DataFrame, input_col: str, output_col: str) -> DataFrame:
    """All lines of text that a form analysis found, joined by spaces."""
    pages = F.col(f"`{input_col}`")["analyzeResult"]["readResults"]
    lines = F.flatten(F.transform(pages, lambda p: F.transform(p["lines"], lambda x: x["text"])))
    return df.withColumn(output_col, F.array_join(lines, " "))


def search_documents(df: DataFrame, base: str, index: str, key: str, action_col: str | None = None, batch_size: int = 100, api: str = "2019-05-06", **options) -> DataFrame:
    """Rows upserted to a search index in batches; (code, reason) of each batch. ``action_col`` names what to do with a row."""
    action = F.col(f"`{action_col}`") if action_col else F.lit("mergeOrUpload")
    rows = df.select(F.struct(action.alias("@search.action"), *[F.col(f"`{c}`") for c in df.columns if c != action_col]).alias("document"))
    from stagekit.operators.columns import fixed_minibatch

    batched = fixed_minibatch(rows, batch_size)
    url = f"{base.rstrip('/')}/indexes/{index}/docs/index?api-version={api}"
    asked = batched.select(http.json_request(F.struct(F.col("document").alias("value")), url, "POST", {"api-key": key}).alias("request"))
    return http.send(asked, "request", "response", **options).select(F.col("response")["code"].alias("code"), F.col("response")["reason"].alias("reason"))
