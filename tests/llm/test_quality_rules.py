"""Quality rules against plain Python on a fixture, and their verdicts on the labelled table."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from causeway.llm import quality_rules as q

KIND = "doc_id long, text string, rules string, n_words long"
EN = "The house of the man and a dog is in that street for it to see, and the cat sat. "
rnd = random.Random(4)


def prose(n):
    return " ".join(rnd.choice(["the", "of", "and", "to", "in"]) if rnd.random() < 0.4 else
                    "".join(rnd.choice("abcdefghilmnoprst") for _ in range(rnd.randint(4, 9))) + rnd.choice(["", "", "", ",", "."])
                    for _ in range(n))


TEXTS = [None, "", "   \t\n", "one two three", "a b c a b c", "a b c x a b c", "a a a a a a", EN * 3, EN * 40, prose(300), prose(3000),
         (prose(80) + "\n") * 2 + "\n\n" + prose(30), "x\ny\nx\n x\n\n\nx", " a  b\x1cc   d", prose(120).upper().replace(" ", "!! "),
         " | ".join(prose(200).split()), " ".join(w + "$$$" for w in prose(150).split()), "z" * 5000, prose(20000), prose(300), prose(60) + " #*$%&|<>"]


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams, cover = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(3)}
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t, "clash", 5) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8], None, None)] * 2
    return q.score_rules(spark.createDataFrame(rows, KIND).repartition(3)).select("doc_id", "text", F.col("n_words").alias("clash"), "rules.*").collect()


def test_counts_match_brute_force(scored):
    assert len(scored) == len(TEXTS) + 2
    for r in scored:
        n_words, word_chars, n_symbols, n_dup, n_repeat, failed = brute(r["text"])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == \
            (n_words, word_chars, n_symbols, n_dup, n_repeat, failed), r["text"] and r["text"][:60]
        assert not (r.kept and r.base_failed)


def test_verdicts(scored):
    kept = {r.doc_id: r.kept for r in scored if r.doc_id is not None}
    assert all(kept[i] for i in (9, 10, 18, 19, 20))
    assert not any(kept[i] for i in (0, 1, 2, 3, 7, 8, 14, 15, 16, 17))


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m) if b) / 2)


def test_distances_match_brute_force(scored):
    for r in scored:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            assert r.word_distance == 1.0
            continue
        best = (9, 0)
        for common in q.COMMON_WORDS.values():
            shares = [sum(x in (c, c.capitalize()) for x in w) / len(w) for c in common]
            ref = list(q.SHARES)
            best = min(best, (js([*shares, 1 - sum(shares)], [*ref, 1 - sum(ref)]), sum(shares)))
        best, share = best
        assert abs(best - r.word_distance) < 1e-9
        counts = [0] * 6
        for c in t:
            counts[3 if c in q.WHITE else 1 if c.isupper() else 2 if c in "0123456789" else 4 if c in ".,;:!?" else
                   5 if c < "\x80" and not c.isalpha() else 0] += 1
        assert abs(min(js([c / len(t) for c in counts], ref) for ref in q.PROSE.values()) - r.class_distance) < 1e-9
        if r.n_words >= q.MIN_COMMON_WORDS and best > q.MAX_WORD_DISTANCE and share < sum(q.SHARES):
            kinds = Counter(x.strip(".,;:!?\"'()[]").lower() for x in w)
            top = [c / len(w) for c in sorted(kinds.values(), reverse=True)[:10]] + [0.0] * max(0, 10 - len(kinds))
            assert abs(js([*top, 1 - sum(top)], [*q.SHARES, 1 - sum(q.SHARES)]) - r.rank_distance) < 1e-9
        else:
            assert r.rank_distance is None


def test_labelled_table_and_plan(spark, sf_dir):
    df = q.op7_quality_rules(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = df.where("not base_failed and n_words >= 100").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.98 * len(rows)
    assert q.score_rules(spark.createDataFrame([], KIND)).count() == 0


#: Ordinary sentences in languages without a list of common words.
OTHER = {
    "pl": """W sobotę rano pojechaliśmy z dziećmi nad jezioro, bo w mieście było zbyt gorąco. Na brzegu siedział stary rybak i opowiadał o tym, jak kiedyś łowił tu wielkie ryby.
Dzieci słuchały go z otwartymi ustami, a potem poszły się kąpać. Woda była zimna, ale nikt się tym nie przejmował. Po południu zjedliśmy chleb z serem i pomidory, które mama kupiła na targu.
Kiedy zaczęło padać, schowaliśmy się w małym drewnianym domku i graliśmy w karty. Wieczorem wróciliśmy do domu zmęczeni, ale bardzo zadowoleni. Ojciec powiedział, że w przyszłym roku pojedziemy tam na dłużej,
może nawet na cały tydzień. Siostra chciała zabrać ze sobą psa, lecz babcia nie była z tego pomysłu zadowolona. W końcu wszyscy się zgodzili, że pies też potrzebuje wakacji i że na wsi będzie mu dobrze.""",
    "ru": """В субботу утром мы поехали с детьми на озеро, потому что в городе было слишком жарко. На берегу сидел старый рыбак и рассказывал о том, как он когда-то ловил здесь больших рыб.
Дети слушали его с открытым ртом, а потом пошли купаться. Вода была холодной, но никто на это не обращал внимания. После обеда мы ели хлеб с сыром и помидоры, которые мама купила на рынке.
Когда начался дождь, мы спрятались в маленьком деревянном доме и играли в карты. Вечером мы вернулись домой усталые, но очень довольные. Отец сказал, что в следующем году мы поедем туда надолго,
может быть, даже на целую неделю. Сестра хотела взять с собой собаку, но бабушка не была этому рада. В конце концов все согласились, что собаке тоже нужен отдых и что в деревне ей будет хорошо.""",
    "it": """Sabato mattina siamo andati al lago con i bambini, perché in città faceva troppo caldo. Sulla riva sedeva un vecchio pescatore che raccontava di quando prendeva qui dei pesci molto grandi.
I bambini lo ascoltavano a bocca aperta e poi sono andati a fare il bagno. L'acqua era fredda, ma a nessuno importava. Nel pomeriggio abbiamo mangiato il pane con il formaggio e i pomodori che la mamma aveva comprato al mercato.
Quando ha cominciato a piovere, ci siamo riparati in una piccola casa di legno e abbiamo giocato a carte. La sera siamo tornati a casa stanchi ma molto contenti. Il papà ha detto che l'anno prossimo ci andremo per più tempo,
forse anche per una settimana intera. La sorella voleva portare il cane, ma la nonna non era contenta di questa idea. Alla fine tutti hanno detto che anche il cane ha bisogno di una vacanza e che in campagna starà bene.""",
    "tr": """Cumartesi sabahı çocuklarla birlikte göle gittik, çünkü şehirde hava çok sıcaktı. Kıyıda yaşlı bir balıkçı oturuyor ve eskiden burada nasıl büyük balıklar tuttuğunu anlatıyordu.
Çocuklar onu ağzı açık dinledi, sonra da yüzmeye gitti. Su soğuktu ama bu kimsenin umurunda değildi. Öğleden sonra annemin pazardan aldığı peynir, ekmek ve domatesleri yedik.
Yağmur başlayınca küçük bir ahşap eve sığındık ve bir süre kâğıt oynadık. Akşam yorgun ama çok mutlu bir şekilde eve döndük. Babam gelecek yıl oraya daha uzun bir süre için gideceğimizi söyledi,
belki de bütün bir hafta için. Kız kardeşim köpeği de almak istedi, ama büyükannem bu fikri çok sevmedi. Sonunda herkes köpeğin de bir tatile ihtiyacı olduğunu ve köyde çok iyi olacağını kabul etti.""",
    "el": """Το Σάββατο το πρωί πήγαμε με τα παιδιά στη λίμνη, γιατί στην πόλη έκανε πολλή ζέστη. Στην όχθη καθόταν ένας γέρος ψαράς και έλεγε για το πώς κάποτε έπιανε εδώ μεγάλα ψάρια.
Τα παιδιά τον άκουγαν με ανοιχτό το στόμα και μετά πήγαν να κολυμπήσουν. Το νερό ήταν κρύο, αλλά κανείς δεν το πρόσεχε. Το απόγευμα φάγαμε ψωμί με τυρί και τις ντομάτες που η μαμά αγόρασε από την αγορά.
Όταν άρχισε να βρέχει, κρυφτήκαμε σε ένα μικρό ξύλινο σπίτι και παίξαμε χαρτιά. Το βράδυ γυρίσαμε στο σπίτι κουρασμένοι, αλλά πολύ χαρούμενοι. Ο πατέρας είπε ότι του χρόνου θα πάμε εκεί για πιο πολύ καιρό,
ίσως και για μια ολόκληρη εβδομάδα. Η αδελφή μου ήθελε να πάρει και τον σκύλο, αλλά η γιαγιά δεν ήταν ευχαριστημένη με αυτή την ιδέα. Στο τέλος όλοι είπαν ότι και ο σκύλος χρειάζεται διακοπές και ότι στο χωριό θα περάσει καλά.""",
}


def gibberish(seed, n, common, stops):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(n)]
    for k in range(common):
        words[r.randrange(n)] = "the"
    if stops:
        words = [w.capitalize() if k % 11 == 0 else w + "." if k % 11 == 10 else w + "," if k % 11 == 5 else w for k, w in enumerate(words)]
    else:
        words[-1] += "."
    return " ".join(words)


def test_prose_of_other_languages_is_kept_and_gibberish_is_not(spark):
    good = list(OTHER.values())
    for seed in range(3):
        for text in OTHER.values():
            lines = re.split(r"(?<=\.)\s+", text)
            random.Random(seed).shuffle(lines)
            good.append(" ".join(lines))
    bad = [gibberish(k, n, c, stops) for k, (n, c, stops) in enumerate([(300, 3, False), (300, 1, True), (300, 0, True), (1000, 1, True), (150, 1, True), (2000, 20, True)])]
    bad += [", ".join(gibberish(40 + k, 200, 1, False).split()) + "." for k in range(2)]           # a list of keywords
    rows = q.score_rules(spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "k int, text string")).select("k", "rules.*").collect()
    wrong = [(r.k, r.n_words, r.class_distance, r.word_distance, r.rank_distance, r.kept) for r in rows if r.kept != (r.k < len(good))]
    assert not wrong


def test_a_column_of_the_same_name_is_free_to_stay(spark):
    df = spark.createDataFrame([("mine", EN)], "rules string, text string")
    assert q.score_rules(df, out="_verdict").select("rules", "_verdict.kept").collect()[0].rules == "mine"
