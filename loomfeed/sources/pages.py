"""Saved pages to rows (EXT1 to EXT9).  A small parser gives the nodes of marked cards and the places where a page names its
product; which of them counts, and all that is read from their texts, is columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, md5_of, normalize, remove_invalid_xml_chars, review_date, text_or_empty
from ..shipping import ship
from .page_nodes import HINTED, page_rows, titles_and_shops

# What tells a marketplace, in this order.
PLATFORM_SIGNALS = {"tmall": ("tmall.com", "天猫", "天猫超市", "天猫国际"), "taobao": ("taobao.com", "淘宝", "已买到的宝贝", "收藏夹"), "jd": ("jd.com", "京东", "京东商城"), "pdd": ("pinduoduo.com", "yangkeduo.com", "拼多多"), "douyin": ("douyin.com", "抖音商城", "抖音电商")}
QUESTIONS_MARK = "问大家"
SAVED_HOSTS = {"tmall": "tmall.com", "taobao": "taobao.com", "jd": "jd.com"}
# Words that no product's title holds; what sites and exports add to titles and file names; lines of a review
# that say nothing.
TITLE_NOISE = ("距结束", "距离结束", "离结束", "商品评价", "商品", "问大家", "买家评价", "大家评", "店铺", "客服", "推荐", "按图片搜索", "优惠前", "优惠后", "店铺优惠", "参数", "参数信息", "图文详情", "本店推荐", "看了又看")
TITLE_ENDS = ("淘宝网", "天猫", "京东", "商品详情", "价格", "报价", "评价")
FILE_ENDS = ("tmall.com天猫", "taobao.com淘宝", "淘宝网", "天猫", "京东", "jd.com")
REVIEW_NOISE = r"^(?:商品评价|累计评价|全部评价|有图|好评|中评|差评|默认好评|该用户未填写评价内容|\d+)$"


def read_pages(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """SRC5: page files with their bytes' sha256, time of capture and text (the first encoding that fits, without characters
    that XML does not allow); a broken or encrypted archive is an empty page and does not stop the others."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[hH][tT][mM]*").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        def text_of(data: bytes) -> str:
            if data[:4] == b"PK\x03\x04":
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        pages = [n for n in z.namelist() if n.lower().endswith((".html", ".htm"))]
                        data = z.read(next((n for n in pages if n.lower().endswith("index.html")), pages[0])) if pages else b""
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):  # broken, or encrypted
                    return ""
            for encoding in ("utf-8-sig", "gb18030", "gbk"):
                try:
                    return data.decode(encoding)
                except UnicodeDecodeError:
                    continue
            return data.decode("utf-8", "replace")

        for x in it:
            yield x.assign(html=[text_of(bytes(b)) for b in x["content"]]).drop(columns="content")

    base = files.select("path", F.date_trunc("second", "modificationTime").alias("capture_time"), F.sha2("content", 256).alias("file_hash"), "content")
    return base.mapInPandas(decode, "path string, capture_time timestamp, file_hash string, html string").withColumn("html", remove_invalid_xml_chars(F.col("html")))


def page_identity(pages: DataFrame, key: str = "page_id", html: str = "html", file_name: str = "path") -> DataFrame:
    """SRC6: page, platform, product_id, product_url, product_title, shop_name, capture_time and file_hash (where pages have
    them, else the sha256 of the text)."""
    own = pages.select(
        F.col(key).cast("string").alias("page"), platform_of(F.col(html), F.col(file_name)).alias("platform"), product_url(F.col(html)).alias("product_url"),
        F.col("capture_time").cast("string").alias("capture_time") if "capture_time" in pages.columns else F.lit("").alias("capture_time"), F.col("file_hash") if "file_hash" in pages.columns else F.sha2(text_or_empty(F.col(html)), 256).alias("file_hash"),
    ).withColumn("product_id", product_id(F.col("product_url")))
    return own.join(page_products(pages, key, html, file_name), "page", "left")


def platform_of(html: Column, file_name: Column) -> Column:
    """EXT1: the host a page says it was saved from; else tmall or taobao by the questions' mark; else the platform with most
    signals, the first of equals; else unknown.  Looked for in the whole page, where the reference reads its beginning alone."""
    saved = F.lower(F.regexp_extract(html, r"(?i)Page saved with SingleFile\s+url:\s*https?://([^\s<:/?#]+)", 1))
    by_host = F.coalesce(*(F.when((saved == host) | saved.endswith(f".{host}"), p) for p, host in SAVED_HOSTS.items()))
    sample = F.lower(F.concat_ws("\n", text_or_empty(file_name), text_or_empty(html)))
    score = {p: sum((sample.contains(s.lower()).cast("int") for s in signals), F.lit(0)) for p, signals in PLATFORM_SIGNALS.items()}
    best = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(p).alias("p")) for i, (p, n) in enumerate(score.items()))))
    most = F.when(best["n"] == 0, "unknown").otherwise(best["p"])
    return F.coalesce(by_host, F.when(sample.contains(QUESTIONS_MARK), F.when(score["tmall"] > 0, "tmall").otherwise("taobao")), most)


def product_url(html: Column) -> Column:
    """EXT2: the canonical link, else og:url, else the first marketplace link."""
    patterns = (r"(?i)<link[^>]*rel=[\"']?canonical[\"']?[^>]*href=[\"']([^\"']+)", r"(?i)<meta[^>]*property=[\"']og:url[\"'][^>]*content=[\"']([^\"']+)", r"(https?://[^\s\"'<>]*(?:tmall|taobao|jd)\.com[^\s\"'<>]*)")
    return F.coalesce(*(F.nullif(F.regexp_extract(text_or_empty(html), p, 1), F.lit("")) for p in patterns), F.lit(""))


def product_id(url: Column) -> Column:
    """EXT2: an id in the query, else in the path."""
    keys = [F.nullif(F.regexp_extract(url, rf"[?&]{k}=([0-9A-Za-z_-]+)", 1), F.lit("")) for k in ("id", "itemId", "item_id", "goods_id", "goodsId")]
    paths = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"/(\d{5,})\.html", r"/item/(\d{5,})")]
    return F.coalesce(*keys, *paths, F.lit(""))


def _clean_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(clean_text(c), rf"(?i)(?:\s*(?:[-_—|｜]\s*)?(?:{'|'.join(TITLE_ENDS)})\s*)+$", ""))


def _is_title(c: Column) -> Column:
    title = _clean_title(c)
    noisy = ~clean_text(c).isin(*TITLE_NOISE)
    for term in TITLE_NOISE:
        noisy = noisy & ~title.contains(term)
    return noisy & (F.length(title) >= 2) & ~title.rlike(r"^用户评价\s*[·\-\s]*\d+\+?$")


def title_of_file(file_name: Column) -> Column:
    """EXT3: a file's name without its kind, the time of saving and the site's name."""
    name = F.regexp_replace(F.element_at(F.split(text_or_empty(file_name), r"[\\/]+"), -1), r"(?i)(?:\.u\.zip\.html|\.zip\.html|\.html|\.htm)$", "")
    name = F.regexp_replace(name, r"\s*\(\d{4}[-_]\d{1,2}[-_]\d{1,2}\s+\d{1,2}：\d{1,2}：\d{1,2}\)\s*$", "")
    ends = "|".join(e.replace(".", r"\.") for e in FILE_ENDS)
    return F.regexp_replace(name, rf"(?i)\s*[-_—|｜]\s*(?:{ends})\s*$", "")


def page_products(pages: DataFrame, key: str = "page_id", html: str = "html", file_name: str = "path") -> DataFrame:
    """EXT3: page, product_title and shop_name.  Titles in order of trust: the panel of variants (taobao and tmall), classes of
    product titles, JSON-LD, meta tags, the page's title, the file's name, headings; the first that is no noise counts, without
    what sites add to it.  Shops: JSON-LD's seller, classes of shop names, JSON-LD's brand."""
    ship(pages.sparkSession)
    name = F.col(file_name) if file_name in pages.columns else F.lit("")
    rows = pages.select(F.col(key).cast("string").alias("page"), text_or_empty(F.col(html)).alias("html"), text_or_empty(name).alias("file_name"), platform_of(F.col(html), name).isin("taobao", "tmall").alias("panel"))
    found = rows.mapInPandas(titles_and_shops, "page string, file_name string, panel boolean, titles array<struct<rank:int,text:string>>, shops array<string>")
    titles = F.concat(F.filter("titles", lambda t: F.col("panel") | (t["rank"] > 0)), F.array(F.struct(F.lit(5).alias("rank"), title_of_file(F.col("file_name")).alias("text"))))
    texts = F.transform(F.array_sort(F.transform(titles, lambda t, i: F.struct(t["rank"].alias("rank"), i.alias("i"), t["text"].alias("text")))), lambda t: t["text"])
    title = F.get(F.transform(F.filter(texts, _is_title), _clean_title), F.lit(0))
    shop = F.get(F.filter(F.transform("shops", clean_text), lambda x: x != ""), F.lit(0))
    return found.select("page", text_or_empty(title).alias("product_title"), text_or_empty(shop).alias("shop_name"))


NODES = "page string, node long, card long, tag string, class_name string, attrs string, after string, inside_user boolean, text string, block string, node_id string, src string, width string, height string, tags array<string>"


def card_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", kind: str = "review", hinted: int | None = HINTED) -> DataFrame:
    """The nodes of each page's cards of a kind (review or question), in order: the card itself first, with its block of lines.
    Of cards that only their names hint at, the first `hinted` of a page count, as this format has it (None: all)."""
    ship(pages.sparkSession)
    return pages.select(F.col(key).cast("string").alias("page"), text_or_empty(F.col(html)).alias("html")).mapInPandas(page_rows(kind, hinted), NODES)


def _first(*patterns: str, where: Column | None = None, column: str = "attrs") -> Column:
    """An aggregate over a card's nodes: the first text, in page order, whose node the earliest possible pattern names."""
    rank = F.coalesce(*(F.when(F.col(column).rlike(f"(?i){p}"), i) for i, p in enumerate(patterns)))
    ok = rank.isNotNull() & F.col("block").isNull() & (F.col("clean") != "")
    return F.coalesce(F.min_by("clean", F.when(ok if where is None else ok & where, F.struct(rank.alias("r"), F.col("node")))), F.lit(""))


def _cards(nodes: DataFrame) -> DataFrame:
    """Nodes with clean texts; of the card itself, which alone has a block, the clean lines and its place."""
    own = F.col("block").isNotNull()
    return nodes.withColumns({"clean": clean_text(F.col("text")), "lines": F.when(own, clean_text(F.col("block"))), "root": F.when(own, F.col("node"))})


def reviews_of_pages(nodes: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """EXT4: one row a card: text (else the longest line that says something), user, sku, later addition, reply, date, rating,
    likes and media; equal ones of a page once.  meta: page, platform and product_id, which the hash takes in."""
    cards = _cards(nodes).groupBy("page", "card").agg(
        F.max("lines").alias("block"), F.min("root").alias("root"),
        _first(r"^content--", r"(review|comment|rate|feedback).*(content|text|body)", r"(content|text).*(review|comment|rate|feedback)", r"(评价|评论).*(内容|正文)").alias("found"),
        _first(r"(seller|merchant|shop).*(reply|response)", r"商家.*回复").alias("reply_text"), _first(r"(append|followup|additional)", r"追评").alias("append_text"), _first(r"^meta--").alias("meta_text"),
        _first(r"(sku|variant|spec|property)", r"(规格|型号|款式)").alias("own_sku"), _first(r"(user|buyer|member).*(name|nick)", r"(用户名|昵称)").alias("own_user"),
        _first("", where=F.col("inside_user") & (F.col("tag") == "span")).alias("user_span"),
        F.coalesce(F.min_by("node_id", "node"), F.lit("")).alias("platform_review_id"), F.count_if(F.col("tag") == "img").alias("image_count"), F.count_if(F.col("tag") == "video").alias("video_count"),
        F.max(F.regexp_extract("class_name", r"star-?([1-5])", 1)).alias("stars"),
    ).where(F.length("block").between(4, 5000))
    lines = F.filter(F.transform(F.split("block", "\n"), clean_text), lambda x: (x != "") & ~x.rlike(REVIEW_NOISE))
    longest = F.array_max(F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    # From an array of one element, what is looked at more than once is made once a row, before the filters.
    cards = cards.select("*", F.explode(F.array(text_or_empty(F.when(F.col("found") != "", F.col("found")).otherwise(longest)))).alias("text"))
    cards = cards.where((F.length("text") >= 2) & ~F.col("text").rlike(REVIEW_NOISE) & ~F.col("text").isin(F.col("reply_text"), F.col("append_text")))
    raw, day = review_date(F.when(F.col("meta_text") != "", F.col("meta_text")).otherwise(F.col("block")))
    said = F.regexp_extract("block", r"([1-5](?:\.\d)?)\s*(?:分|星)", 1)
    bought = clean_text(F.regexp_extract("meta_text", r"(?s)已购：(.*)$", 1))
    cards = cards.withColumns({
        "review_date_raw": raw, "review_date": day, "rating": F.coalesce(F.nullif(said, F.lit("")), F.col("stars")).try_cast("double").cast("int"), "like_count": F.regexp_extract("block", r"(?:有用|点赞|赞)\s*(\d+)", 1).try_cast("int"),
        "sku": F.when(F.col("own_sku") != "", F.col("own_sku")).otherwise(bought), "user": F.when(F.col("own_user") != "", F.col("own_user")).otherwise(F.col("user_span")), "confidence": F.when(F.col("text") != F.col("block"), 0.9).otherwise(0.6),
    })
    cards = cards.join(meta.select("page", "platform", "product_id"), "page", "left") if meta is not None else cards.withColumns({"platform": F.lit(""), "product_id": F.lit("")})
    cards = cards.withColumn("content_hash", md5_of(*(F.col(c) for c in ("platform", "product_id", "text", "review_date_raw", "sku"))))
    first = Window.partitionBy("page", "content_hash").orderBy("root")
    kept = cards.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("page", "card", "platform_review_id", "text", "user", "sku", "append_text", "reply_text", "review_date_raw", "review_date", "rating", "like_count", "image_count", "video_count", "confidence", "content_hash")


def questions_of_pages(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """EXT5: one row a card (card_nodes of kind question) with a question: its answer, the answer count, the status of who
    answers, the page's tags; equal pairs of a page once.  meta: page, platform, product_id, marked (the page says that it has
    questions); pages of other platforms without the mark have none.  A question without an answer has confidence 0.55."""
    cards = _cards(nodes).join(meta.select("page", "platform", "product_id", "marked"), "page").where(F.col("platform").isin("taobao", "tmall") | F.col("marked"))
    after = lambda name: _first(name, column="after")
    stated = F.col("tag").isin("span", "div") & ~F.col("clean").isin("问", "查看全部回答", "已购", "回头客") & (F.col("block").isNull()) & (F.col("clean") != "")
    found = cards.groupBy("page", "card", "platform", "product_id").agg(
        F.max("lines").alias("block"), F.min("root").alias("root"), F.first("tags", ignorenulls=True).alias("tags"), after("questionIcon--").alias("icon_question"), after("initTag--").alias("tag_answer"), _first("initTag--", column="class_name").alias("status"),
        _first("(question|ask|quest|issue|问)").alias("hint_question"), _first("(answer|reply|response|答)").alias("hint_answer"), F.sort_array(F.collect_list(F.when(stated, F.struct("node", "clean")))).alias("said"),
    ).where(F.length("block").between(4, 3000))
    bare = lambda c, mark: clean_text(F.regexp_replace(c, rf"^\s*(?:{mark})\s*[:：]?\s*", ""))
    found = found.select("*", F.explode(F.array(F.filter(F.transform(F.split("block", "\n"), clean_text), lambda x: x != ""))).alias("_lines"))
    marked = lambda mark: F.transform(F.filter("_lines", lambda x: x.rlike(rf"(?i)^(?:{mark})\s*[:：]")), lambda x: bare(x, mark))
    useful = F.filter("_lines", lambda x: ~x.rlike(r"^(?:已购|查看.*|全部回答|\d+个?回答)$"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    guessed = (F.size("_asked") == 0) & (F.size(useful) >= 2)
    some = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    others = F.filter("said", lambda x: (x["clean"] != F.col("icon_question")) & (x["clean"] != F.col("status")) & ~x["clean"].startswith(F.concat(F.lit("问"), F.col("icon_question"))))
    icon_answer = F.when((F.col("icon_question") != "") & (F.col("tag_answer") == ""), last(others)["clean"]).otherwise(F.col("tag_answer"))
    # From an array of one element, what is looked at more than once is made once a row, before the filters.
    once = lambda df, **named: df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in named.items())))))
    found = once(found, _q=some(bare(some(F.col("icon_question"), F.col("hint_question")), "问题|问|Q")), _a=some(bare(some(icon_answer, F.col("hint_answer")), "回答|答|A")), _asked=marked("问题|问|Q"))
    found = once(found, question=some(F.col("_q"), last("_asked"), F.when(guessed, F.get(useful, F.lit(0)))), _answer=some(F.col("_a"), F.when(guessed, F.get(useful, F.lit(1))).otherwise(last(marked("回答|答|A")))))
    found = found.where("question <> ''").withColumn("answer", F.when(F.col("_answer") == F.col("question"), "").otherwise(F.col("_answer")))
    buyer = F.col("block").rlike("已购|购买过|买家")
    found = found.withColumns({
        "answer_count": F.regexp_extract("block", r"(\d+)\s*个?回答", 1).try_cast("int"), "is_buyer_answer": buyer, "answer_user_status": some(F.col("status"), F.when(buyer, "已购")),
        "question_tags": F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 30), ";"), "confidence": F.when(F.col("answer") != "", 0.9).otherwise(0.55), "qa_hash": md5_of(*(F.col(c) for c in ("platform", "product_id", "question", "answer"))),
    })
    first = Window.partitionBy("page", "qa_hash").orderBy("root")
    kept = found.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("page", "card", "question", "answer", "answer_count", "is_buyer_answer", "answer_user_status", "question_tags", "confidence", "qa_hash")


def question_pairs(text: Column) -> tuple[Column, Column]:
    """EXT5: question and answer of a block, by their marks."""
    q = F.trim(F.regexp_extract(text_or_empty(text), r"(?s)(?:问|Q|q)\s*[:：]?\s*(.+?)(?:\n\s*(?:答|A|a)\s*[:：]|$)", 1))
    a = F.trim(F.regexp_extract(text_or_empty(text), r"(?s)\n\s*(?:答|A|a)\s*[:：]\s*(.+)$", 1))
    return q, F.when(a == q, "").otherwise(a)


def contents_of(reviews: DataFrame, questions: DataFrame) -> DataFrame:
    """EXT6, EXT7: reviews, later additions, questions and answers in one list with an order; empty answers are left out.  A row
    gives its one or two contents at once, so that no page is read again for the second."""

    def pairs(df: DataFrame, kind: int, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
        content = lambda role, text, parent: F.struct(F.lit(role).alias("content_role"), F.col(text).alias("content_text_clean"), parent.alias("parent_text_clean"))
        (role, text), (other, more) = first, second
        own = F.array_compact(F.array(content(role, text, F.lit("")), F.when(F.col(more) != "", content(other, more, F.col(text)))))
        return df.select("page", F.lit(kind).alias("_p"), F.col("card").alias("_o"), F.explode(own).alias("c")).select("page", "_p", "_o", "c.*")

    both = pairs(reviews, 0, ("review", "text"), ("followup", "append_text")).unionByName(pairs(questions, 1, ("question", "question"), ("answer", "answer")))
    return both.withColumn("content_order", F.row_number().over(Window.partitionBy("page").orderBy("_p", "_o", "content_role"))).drop("_p", "_o")


def content_all_of(contents: DataFrame) -> DataFrame:
    """EXT7: contents_of with content_hash, each once in a page, and content_id, dense in a page's order."""
    hashed = contents.withColumn("content_hash", md5_of(*(F.col(c) for c in ("page", "content_role", "content_text_clean", "parent_text_clean"))))
    first = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("page", "content_hash").orderBy("content_order"))).where("_n = 1").drop("_n")
    return first.withColumn("content_id", F.row_number().over(Window.partitionBy("page").orderBy("content_order")))


def images_of(nodes: DataFrame) -> DataFrame:
    """EXT8: embedded images of cards (base64 or percent-encoded) with bytes, hash and number within card and stage; equal ones
    once; others missing; icons and images of at most 48 by 48 are none."""
    small = F.coalesce((F.col("width").try_cast("int") <= 48) & (F.col("height").try_cast("int") <= 48), F.lit(False))
    img = nodes.where((F.col("tag") == "img") & ~F.col("class_name").rlike("(?i)(avatar|icon|logo|emoji)") & ~small)
    stage = F.when(F.col("class_name").rlike("(?i)append"), "append").otherwise("review")
    coded, plain = (F.regexp_extract("src", p, 1) for p in (r"^data:image/[a-zA-Z+.-]+;base64,(.+)$", r"(?s)^data:image/[^,]*,(.+)$"))
    data = (F.when(coded != "", F.try_to_binary(coded, F.lit("base64"))).when(plain.rlike("^(?:%[0-9A-Fa-f]{2})+$"), F.unhex(F.replace(plain, F.lit("%"), F.lit(""))))
        .when(plain != "", F.try_url_decode(plain).cast("binary")))
    img = img.select("page", "card", "node", stage.alias("image_stage"), F.when(F.col("src").startswith("data:image/"), data).alias("data"))
    img = img.withColumn("content_sha256", F.when(F.length("data") > 0, F.sha2("data", 256)))
    once = Window.partitionBy("page", "card", "image_stage", "content_sha256").orderBy("node")
    kept = img.withColumn("_n", F.row_number().over(once)).where("_n = 1 or content_sha256 is null")
    place = Window.partitionBy("page", "card", "image_stage").orderBy("node")
    return kept.select("page", "card", "image_stage", F.row_number().over(place).alias("image_index"), "content_sha256", F.when(F.col("content_sha256").isNull(), "missing").otherwise("embedded").alias("extract_status"), "data")


def collector_rows(df: DataFrame) -> DataFrame:
    """EXT9: rows of a collector: white space squeezed, empty texts dropped, date and rating read, a hash of six parts."""
    raw, day = review_date(F.col("time"))
    squeezed = F.trim(F.regexp_replace(text_or_empty(F.col("text")), r"(?U)\s+", " "))
    out = df.withColumns({"review_text": squeezed, "review_date_raw": raw, "review_date": day, "rating_value": F.regexp_extract(text_or_empty(F.col("rating")), r"([1-5])", 1).try_cast("int")}).where("review_text <> ''")
    return out.withColumn("review_hash", md5_of(*(normalize(F.col(c)) for c in ("product_name", "user", "time", "sku", "rating")), normalize(F.col("review_text"))))
