"""Schemas of stored documents and tables."""

from __future__ import annotations

from pyspark.sql import types as T

from keepsift.constants import DIMENSIONS

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


BOX = _struct(x=_D, y=_D, width=_D, height=_D)
WEIGHTS = _struct(**{d: _D for d in DIMENSIONS})
FACE_METADATA = _struct(
    hasFaces=_B, faceCount=_I, eyesOpen=_B, blinkDetected=_B, expressionNeutral=_B,
    boundingBoxes=T.ArrayType(BOX), exceedsFaceLimit=_B,
)
SCORE = _struct(
    filename=_S, scores=_struct(**{d: _I for d in DIMENSIONS}), total=_D, tier=_S, reasoning=_S,
    faceMetadata=FACE_METADATA, keywords=T.ArrayType(_S), usage=_struct(inputTokens=_L, outputTokens=_L),
    thumbnailPath=_S,
)
SHORTFALL = _struct(
    duplicatesSkipped=_L, belowThreshold=_L, faceDetectionFailed=_L, exceededFaceLimit=_L, burstGrouped=_L
)
SESSION = _struct(
    sessionId=_S, createdAt=_S, inputFolder=_S, outputFolder=_S, totalImages=_L, scoredCount=_L, status=_S,
    scores=T.MapType(_S, SCORE), discoveryContext=_S, outputShortfallReasons=SHORTFALL, elapsedMs=_L,
)
PROFILE = _struct(id=_S, name=_S, genre=_S, weights=WEIGHTS, preferenceText=_S, createdAt=_S, lastUsedAt=_S)
HISTORY = _struct(
    sessionId=_S, date=_S, inputFolder=_S, imageCount=_L, profileUsed=_S, profileName=_S, topScore=_D,
    completedAt=_S, genre=_S, weights=WEIGHTS, preferenceText=_S,
)
