"""Schemas of the relations that are read from files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, B, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()

REPORTS_CSV = _struct(file_name=S, findings_en=S, impressions_en=S)
REPORTS_JSON = T.MapType(S, _struct(Findings_EN=S, Impressions_EN=S))
PAIR = _struct(question=S, answer=S, error=S, raw_output=S)
QA_MAP = T.MapType(S, _struct(qa_pairs=T.ArrayType(PAIR)))
QA_LIST = T.ArrayType(_struct(case_id=S, file_name=S, case=S, base_volume=S, variant=S, qa_pairs=T.ArrayType(PAIR)))
QA_ROW = _struct(case_id=S, image_path=S, question=S, answer=S, meta=T.MapType(S, S))
PREDICTION = _struct(case_id=S, image_path=S, question=S, answer=S, prediction=S, prediction_raw=S, model_id=S, num_slices=I, num_slices_used=I)
JUDGMENT = _struct(case_id=S, question=S, answer=S, prediction=S, is_correct=B, reasoning=S)
LABEL = _struct(index=I, is_spatial=B, is_relevant=B, reasoning=S)
METRICS = _struct(model=S, count=T.LongType(), sbert_cosine=D, bleu=D, rouge1_f=D, rouge2_f=D, rougeL_f=D, meteor=D)
LENGTH_SERIES = _struct(labels=T.ArrayType(S), series=T.ArrayType(T.ArrayType(I)), include_questions=B)
DISAGREEMENT = _struct(type=S, case=S, question=S, answer=S, index=I, user=S, human=B, gemini=B)
ASSIGNMENTS = T.MapType(S, T.ArrayType(S))
VOLUME = _struct(case_id=S, shape=T.ArrayType(I), spacing=T.ArrayType(D), affine=T.ArrayType(D), data=T.ArrayType(T.FloatType()))
SLICE_PACK = _struct(case_id=S, slice_idx=I, rgb=T.BinaryType())
