"""Document and segment languages by compression against per-language dictionaries."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textvec as tv
from ..functions.labels import label_code

# A little plain prose in each language, from which the dictionaries start.
SEEDS = {
    "en": "The people who live in this town have always said that the river was wider when they were young. Most of them still walk to the market in the morning, and some of these walks are very long. After the storm, many of those houses were without light for more than a week, but their neighbours helped them with food and water. It is not clear why the school was closed in 2004. According to several reports from the council, the costs were higher than expected. By contrast, the new library has been a success: at first only a few readers came, then their number grew by 30 percent. Over time, these changes shaped how young and old people speak about the place. As a rule, the oldest members of the club decide which songs are played during the summer tour, and the others follow. Between 1998 and 2003, most visitors arrived by train; since then, large groups have come by bus. In this paper we ask whether that had an effect on local shops, on the health of workers and on what children learn. Even so, none of the results should be read as proof. Once again, we thank everyone who answered our questions.",
    "es": "La gente que vive en este pueblo siempre ha dicho que el río era más ancho cuando eran jóvenes. La mayoría de ellos todavía camina al mercado por la mañana, y algunos de esos paseos son muy largos. Después de la tormenta, muchas de las casas se quedaron sin luz durante más de una semana, pero los vecinos les ayudaron con comida y agua. No está claro por qué la escuela se cerró en 2004. Según varios informes del consejo, los costes fueron mayores de lo esperado. En cambio, la nueva biblioteca ha sido un éxito: al principio solo llegaron unos pocos lectores, luego su número creció un 30 por ciento. Con el tiempo, estos cambios formaron la manera en que jóvenes y mayores hablan del lugar. Por lo general, los miembros más antiguos del club deciden qué canciones se tocan durante la gira de verano, y los demás siguen. Entre 1998 y 2003, la mayoría de los visitantes llegaron en tren; desde entonces, los grupos grandes han venido en autobús. En este artículo preguntamos si eso tuvo efecto en las tiendas locales, en la salud de los trabajadores y en lo que aprenden los niños. Aun así, ninguno de los resultados debe leerse como prueba. Una vez más, damos las gracias a todos los que respondieron a las preguntas con ayuda de sus familias.",
    "id": "Orang-orang yang tinggal di kota ini selalu mengatakan bahwa sungai itu lebih lebar ketika mereka masih muda. Sebagian besar dari mereka masih berjalan ke pasar pada pagi hari, dan beberapa perjalanan itu sangat panjang. Setelah badai, banyak rumah tidak memiliki lampu selama lebih dari seminggu, tetapi para tetangga membantu mereka dengan makanan dan air. Tidak jelas mengapa sekolah itu ditutup pada tahun 2004. Menurut beberapa laporan dari dewan, biayanya lebih tinggi daripada yang diharapkan. Sebaliknya, perpustakaan baru telah berhasil: awalnya hanya sedikit pembaca yang datang, kemudian jumlahnya meningkat sebesar 30 persen. Seiring waktu, perubahan ini membentuk cara orang muda dan tua berbicara tentang tempat itu. Umumnya, anggota tertua klub memutuskan lagu mana yang dimainkan selama tur musim panas, dan yang lain mengikuti. Antara 1998 dan 2003, sebagian besar pengunjung tiba dengan kereta api; sejak itu, kelompok besar datang dengan bus. Dalam tulisan ini kami bertanya apakah hal itu memengaruhi toko lokal, kesehatan pekerja dan apa yang dipelajari anak-anak. Meski begitu, tidak satu pun hasil boleh dibaca sebagai bukti. Sekali lagi, kami berterima kasih kepada semua orang yang menjawab pertanyaan kami dengan bantuan keluarga mereka.",
    "ko": "이 마을에 사는 사람들은 젊었을 때 강이 더 넓었다고 늘 말했다. 그들 대부분은 여전히 아침에 시장까지 걸어가고, 그 길은 매우 길다. 폭풍이 지나간 뒤에 많은 집은 일주일이 넘도록 불이 없었지만 이웃은 음식과 물로 그들을 도왔다. 학교가 2004년에 왜 문을 닫았는지는 분명하지 않다. 의회의 여러 보고서에 따르면 비용은 예상보다 높았다. 반면에 새로운 도서관은 성공했다. 처음에는 적은 독자가 왔으나 나중에 그 수는 30퍼센트 늘었다. 시간이 지나면서 이러한 변화는 젊은 사람과 나이든 사람이 그 장소에 대해 말하는 방식을 바꾸었다. 대체로 모임의 가장 오래된 회원은 여름 동안 어떤 노래를 연주할지 결정하고 다른 사람은 따랐다. 1998년부터 2003년까지 대부분의 방문객은 기차로 도착했고, 그 이후 커다란 집단은 버스를 타고 왔다. 이 글에서 우리는 그것이 지역의 가게와 노동자의 건강과 아이들의 배움에 영향을 주었는지를 묻는다. 그럼에도 어떤 결과도 증거로 읽어서는 안 된다. 다시 한번 우리는 가족의 도움으로 질문에 답한 모든 사람을 위해 감사를 기록했다.",
    "ja": "この町に住む人々は、若いころは川がもっと広かったといつも言っていた。彼らの多くは今でも朝に市場まで歩き、その道はとても長い。嵐の後、多くの家は一週間以上も明かりがなかったが、隣の人は食べ物と水で彼らを助けた。学校が2004年になぜ閉じたのかは明らかではない。議会のいくつかの報告によれば、費用は予想を上回った。一方、新しい図書館は成功した。初めは少しの読者しか来なかったが、後にその数は30パーセント増えた。時とともに、これらの変化は若い人と年を取った人がその場所について話す方法を変えた。概して、会の最も古い会員は夏の公演中にどの歌を演奏するかを決め、他の人はそれを追った。1998年から2003年まで、多くの来訪者は列車で着き、それ以来、大きな集団はバスで来た。この論文では、それが現地の店、働く人の健康、子どもの学びに影響を与えたかを問う。それでも、どの結果も証拠として読んではならない。再び、家族の助けで質問に答えたすべての人のために感謝を記録した。",
}
LANGUAGES = tuple(sorted(SEEDS))


def _segments(texts: Sequence[str], long: int, step: int) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, the segments' starts (and the end of the last), and the texts'
    offsets into them. Segments are sentences or lines; where one is over `long`
    code points, it is cut at blanks about every `step`, or exactly there."""
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13)) | (cps == 0xA0) | (cps == 0x3000)
    line = (cps == 10) | (cps == 13)
    wide = (cps == 0x3002) | (cps == 0xFF01) | (cps == 0xFF1F)
    stop = (cps == 0x2E) | (cps == 0x21) | (cps == 0x3F)
    nxt = np.ones(len(cps), dtype=bool)
    nxt[:-1] = blank[1:] | ((cps[1:] >= 0x41) & (cps[1:] <= 0x5A))
    cuts = np.union1d(np.flatnonzero((stop & nxt) | wide | line) + 1, at)
    gaps = np.diff(cuts)
    wide_at = np.flatnonzero(gaps > long)
    if len(wide_at):
        blanks = np.flatnonzero(blank) + 1
        more = []
        for i in wide_at:
            a, b = int(cuts[i]), int(cuts[i + 1])
            while b - a > long:
                j = np.searchsorted(blanks, a + step)
                c = int(blanks[j]) if j < len(blanks) and blanks[j] < min(a + long, b) else a + step
                more.append(c)
                a = c
        cuts = np.union1d(cuts, np.array(more, dtype=np.int64))
    return joined, cuts, np.searchsorted(cuts, at)


def squeezed(text: str) -> bytes:
    """The text as it is compressed: in lower case and without blanks, as capitals and lost blanks say nothing about its language."""
    return "".join(text.lower().split()).encode("utf-8", "surrogatepass")


class Compressors:
    """A zstandard compressor with a raw-content dictionary for each language; contents and pieces are squeezed."""

    def __init__(self, content: Mapping[str, bytes], level: int = 1):
        self.languages = sorted(content)
        self._of = []
        for name in self.languages:
            raw = content[name]
            made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                level, dict_size=len(raw), source_size=256, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            made.precompute_compress(compression_params=how)
            self._of.append(zstandard.ZstdCompressor(dict_data=made, compression_params=how).compress)

    def sizes(self, pieces: Sequence[bytes]) -> np.ndarray:
        """Compressed size of each piece (rows) with each dictionary (columns)."""
        out = np.empty((len(pieces), len(self._of)), dtype=np.int32)
        for k, compress in enumerate(self._of):
            out[:, k] = [len(compress(p)) for p in pieces]
        return out


#: A segment's language is left open if the next best dictionary's size is within this share,
#: or if the segment has fewer letters than this.
NARROW, LEAST_LETTERS = 0.08, 8


def decide(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column of the smallest size, and by what share the next is larger."""
    best = sizes.argmin(axis=1)
    two = np.partition(sizes, 1, axis=1)[:, :2].astype(float)
    return best, (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1)


def segment_languages(texts: Sequence[str], compressors: Compressors, long: int = 300, step: int = 120) -> list[list[tuple[int, int, int, float]]]:
    """For each text its runs (start, end, language index, confidence), which cover it.

    A segment with a narrow margin takes, of the languages of the decided segments
    before and after it, the one that compresses it better. A text with no decided
    segment has no run.
    """
    joined, cuts, at = _segments(texts, long, step)
    pieces = [joined[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    sizes = compressors.sizes([squeezed(p) for p in pieces])
    best, margin = decide(sizes)
    letters = np.array([sum(1 for _ in islice(filter(str.isalpha, p), LEAST_LETTERS)) for p in pieces], dtype=np.int64)
    known = (margin >= NARROW) & (letters >= LEAST_LETTERS)
    out = []
    for i in range(len(texts)):
        lo, hi = int(at[i]), int(at[i + 1])
        sure = np.flatnonzero(known[lo:hi]) + lo
        runs: list[tuple[int, int, int, float]] = []
        if len(sure):
            base = int(cuts[lo])
            lang = best[lo:hi].copy()
            for j in np.flatnonzero(~known[lo:hi]) + lo:
                k = int(np.searchsorted(sure, j))
                near = {int(best[sure[x]]) for x in (k - 1, k) if 0 <= x < len(sure)}
                lang[j - lo] = min(near, key=lambda x: (sizes[j, x], x))
            weight = np.diff(cuts[lo : hi + 1])
            change = np.flatnonzero(np.diff(lang)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), hi - lo]):
                w = np.maximum(weight[a:b], 1)
                runs.append((int(cuts[lo + a]) - base, int(cuts[lo + b]) - base, int(lang[a]), float(np.average(margin[lo + a : lo + b], weights=w))))
        out.append(runs)
    return out


def fit(rows: Sequence[tuple[str | None, str]], dict_bytes: int = 65536, rounds: int = 2) -> dict[str, bytes]:
    """Dictionary contents from (label code, text) rows whose labels may be wrong.

    The seeds' dictionaries decide the rows' segments; those clearly of one language
    are spread evenly over the rows and form the next dictionaries, of at most
    dict_bytes each. The label only breaks ties: a segment within twice the narrow margin
    counts for its row's label alone.
    """
    content = {k: squeezed(v) for k, v in SEEDS.items()}
    for _ in range(rounds if rows else 0):
        compressors = Compressors(content)
        joined, cuts, at = _segments([t for _, t in rows], 300, 120)
        pieces = [joined[a:b].strip() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        raw = [squeezed(p) for p in pieces]
        best, margin = decide(compressors.sizes(raw))
        labels = np.repeat([x or "" for x, _ in rows], np.diff(at))
        names = np.array(compressors.languages)[best]
        clear = (margin >= 2 * NARROW) | ((margin >= NARROW) & (labels == names))
        # Round-robin over rows: the k-th segment of every row comes before any row's k+1-th.
        turn = np.arange(len(pieces)) - np.repeat(at[:-1], np.diff(at))
        order = np.lexsort((np.arange(len(pieces)), turn))
        new: dict[str, list[bytes]] = {k: [squeezed(v)] for k, v in SEEDS.items()}
        room = {k: dict_bytes - len(v[0]) for k, v in new.items()}
        seen: set[bytes] = set()
        for j in order:
            name = str(names[j])
            if clear[j] and len(pieces[j]) >= 30 and room[name] > len(raw[j]) and raw[j] not in seen:
                seen.add(raw[j])
                new[name].append(raw[j])
                room[name] -= len(raw[j]) + 1
        content = {k: b" ".join(v[::-1]) for k, v in new.items()}
    return content


def training_sample(docs: DataFrame, id_col: str, text: Column, label: Column, per_label: int = 48) -> list[tuple[str | None, str]]:
    """At most per_label texts for each of the known label codes and for none: in each of
    per_label hash buckets the row of the least hash, so the choice depends on the ids alone."""
    code = F.when(label_code(label).isin(*LANGUAGES), label_code(label))
    keyed = docs.where(F.char_length(text) > 0).select(id_col, code.alias("code"), F.xxhash64(id_col).alias("h"))
    chosen = keyed.groupBy("code", F.pmod("h", F.lit(per_label)).alias("b")).agg(F.min(F.struct("h", id_col)).alias("m")).select("code", f"m.{id_col}").distinct()
    rows = docs.select(id_col, text.alias("text")).join(F.broadcast(chosen.dropDuplicates([id_col])), id_col).select(id_col, "code", "text").collect()
    return [(r.code, r.text) for r in sorted(rows, key=lambda r: (r[0], r.text)) if r.text]


_OUT = "lang string, confidence double, runs array<struct<start:bigint,stop:bigint,lang:string,confidence:double>>"


def document_languages(docs: DataFrame, keys: Sequence[str], text: Column, content: Mapping[str, bytes]) -> DataFrame:
    """(keys, lang, confidence, runs): each row's main language and its runs of one language.

    The main language is the one with the most characters (of equals the first by code);
    confidence is the size margin between the best and the next dictionary, 0 to 1,
    averaged over its characters. lang and confidence are null and runs is empty for null,
    blank and undecidable texts. Whole texts are read. Repeated rows stay repeated.
    """
    packed = pickle.dumps(dict(content))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = sorted(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(pickle.loads(packed))
        for batch in tv.slices(batches, "text"):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            main, sure, runs = [], [], []
            for found in segment_languages(texts, compressors):
                length = np.zeros(len(names))
                weight = np.zeros(len(names))
                for a, b, k, c in found:
                    length[k] += b - a
                    weight[k] += (b - a) * c
                k = int(length.argmax())
                main.append(names[k] if found else None)
                sure.append(round(float(weight[k] / length[k]), 6) if found else None)
                runs.append([{"start": a, "stop": b, "lang": names[k], "confidence": round(c, 6)} for a, b, k, c in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            columns += [pa.array(main, pa.string()), pa.array(sure, pa.float64()), pa.array(runs, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "lang", "confidence", "runs"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _OUT])
    return docs.select(*keys, text.alias("text")).mapInArrow(run, schema)
