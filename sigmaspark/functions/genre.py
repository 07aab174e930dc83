"""Genre names of discs by table and number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the general and the Japanese table, in the order of their numbers.
GENERAL = (
    "Reserved", "Not defined", "Adult Contemporary", "Alternative Rock", "Children's Music", "Classical", "Contemporary Christian", "Country", "Dance", "Easy Listening",
    "Erotic", "Folk", "Gospel", "Hip Hop", "Jazz", "Latin", "Musical", "New Age", "Opera", "Operetta",
    "Pop Music", "RAP", "Reggae", "Rock Music", "Rhythm & Blues", "Sound Effects", "Sound Track", "Spoken Word", "World Music", "Blues",
)
JAPANESE = (
    "音楽：演歌", "音楽：ポップス歌謡曲", "音楽：ニューミュージック", "音楽：ロック／ディスコ", "音楽：ポピュラーソング／フォークソング", "音楽：ジャズ／フュージョン", "音楽：軽音楽／映画音楽", "音楽：クラシック", "音楽：その他",
    "学芸：民謡／純邦楽", "学芸：民族音楽", "学芸：教育／教材／童謡／童話", "学芸：アニメ", "学芸：その他", "カラオケ：カラオケ", "カラオケ：映像カラオケ",
    "劇映画：邦画", "劇映画：洋画", "劇映画：アダルト", "劇映画：アニメ", "劇映画：その他", "その他：ＢＧＭ", "その他：スポーツ／ドキュメンタリー", "その他：娯楽／教養", "その他：その他",
)


def genre_name(table: Column, number: Column) -> Column:
    """Table 1 is the general one, 2 the Japanese one; null for anything else."""
    general, japanese = (F.array(*map(F.lit, names)) for names in (GENERAL, JAPANESE))
    return F.when(table == 1, F.get(general, number)).when(table == 2, F.get(japanese, number))
