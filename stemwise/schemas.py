"""Explicit schemas of the relations."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields):
    return StructType([StructField(k, v) for k, v in fields.items()])


S, L, I, D, B = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType()
OPTIONS = MapType(S, S)
RAW_RECORD = _struct(archive=S, bank=S, pos=L, data=S, label=S)
ITEM = _struct(item_pos=L, bank=S, question=S, options=OPTIONS, answer=S, shared_stem=B)
ZH_BLOCK = _struct(bank=S, path=S, pos=L, text=S, answer=S)
ZH_ITEM = _struct(sample_index=L, bank=S, question=S, options=OPTIONS, answer=S, excluded=B)
EXAM_CSV = StructType([StructField(c, S) for c in ("Question", "Options", "Answer", "Medical Discipline")])
CSV_ITEM = _struct(cmexam_row=L, bank=S, question=S, options=OPTIONS, answer=S)
RESULT = _struct(bank=S, condition=S, gold=S, pick=S, correct=B)
CONTROL = _struct(control=S, bank=S, gold=S, pick=S)
RUN_RESULT = _struct(model=S, condition=S, bank=S, gold=S, pick=S, correct=B, sample_index=L, cmexam_row=L)
RUN_SUMMARY = _struct(model=S, cond=S, correct=L, n=L, acc=D, lo=D, hi=D, p=D, unparsed=L, fav=S, fav_rate=D, secs=D)
FLAG_MAP = MapType(S, B)
FEATURE_ROW = _struct(id=S, bank=S, answer=S, stem_len=I, opt_len=MapType(S, I), longest_is_answer=B, answer_len_rank=I, shared_stem=B, case_group=S, feat_catch_all=FLAG_MAP, feat_absolute=FLAG_MAP, feat_hedge=FLAG_MAP, feat_numeric=FLAG_MAP)
CLASSIFIER_ROW = _struct(bank=S, gold=S, surface_pick=S, text_pick=S)
SCORED = _struct(item_pos=L, reply=S, error=S)
NUMBERS = ArrayType(S)
