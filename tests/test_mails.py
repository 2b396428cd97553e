from casegrain.operators import corpus
from casegrain.sources import mails

BOX = (
    b"From r  Wed Oct 30 21:41:56 2002\nFrom: \"A B\" <a@example.org>\nSubject: =?utf-8?q?Gesch=C3=A4ft?=\n"
    b" of trust\nDate: Thu, 31 Oct 2002\n\nDear friend,\n\nFrom my heart.\n"
    b"From r  Thu Oct 31 08:11:39 2002\nSubject: base\nContent-Transfer-Encoding: base64\n\nSGVsbG8gd29ybGQ=\n"
    b"From r  x\nSubject: quoted\nContent-Type: text/plain; charset=iso-8859-1\n"
    b"Content-Transfer-Encoding: quoted-printable\n\nd=E9j=E0 vu =\nagain\n"
    b"From r  y\nSubject: raw\n\nd\xe9j\xe0\n"
    b"From r  z\nContent-Type: multipart/alternative; boundary=\"q\"\n\n--q\nContent-Type: text/plain\n\nplain\n"
    b"--q\nContent-Type: text/html\n\n<b>rich</b>\n--q--\n"
)
BODIES = ["Dear friend,\n\nFrom my heart.", "Hello world", "déjà vu again", "déjà", "plain"]


def test_messages_and_their_fields(spark, tmp_path):
    (tmp_path / "box.txt").write_bytes(BOX)
    rows = mails.read_mails(spark, str(tmp_path / "box.txt")).collect()
    assert [r["body"] for r in rows] == BODIES
    assert tuple(rows[0])[:3] == ('"A B" <a@example.org>', "Geschäft of trust", "Thu, 31 Oct 2002")
    assert rows[4]["subject"] is None


def test_a_file_is_cut_at_any_byte(spark, tmp_path):
    (tmp_path / "box.txt").write_bytes(BOX * 40)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = mails.read_mails(spark, str(tmp_path / "box.txt"))
        assert found.rdd.getNumPartitions() > 5
        assert sorted(r["body"] for r in found.collect()) == sorted(BODIES * 40)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_mails_feed_the_loader(spark, tmp_path):
    (tmp_path / "box.txt").write_bytes(BOX)
    rows = corpus.load_labelled(spark, fraud_mail=str(tmp_path / "box.txt")).collect()
    assert sorted(r["raw_text"] for r in rows) == sorted(BODIES)
    assert {r["primary_category"] for r in rows} == {"online_financial_fraud"}
