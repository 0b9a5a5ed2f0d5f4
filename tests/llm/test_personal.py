import re

from threadloom.llm import personal

GIVEN = "Priya Dmitri Ngozi Katarzyna Imani Siobhan Rajesh Mehmet Astrid Giulia Tomasz Leila Kwame Ingrid Matteo Yusuf Camille Joaquim Svetlana Brigitte".split()
FAMILY = "Raman Volkov Adeyemi Nowakowska Mwangi O'Malley Chaudhary Yildiz Lindgren Bianchi Wisniewski Hosseini Mensah Solberg Ricci Demir Laurent Ferreira Morozova Zimmermann".split()
HAN = "张伟 王秀兰 李建国 刘佳 陈晓东 欧阳娜 赵立新 黄海燕 周杰 吴桂珍 司马青 孙志强 马超 朱婷 胡军 林青霞 何平 高圆 罗晋 宋佳".split()
#: Carriers that the training does not have; the person is in brackets.
CARRIERS = (
    "session opened by [{0}] at 10:42", "Perhaps [{0}] knows where the key is.", "Kind regards\n[{0}]", "row 9: [{1}];A1234567;520-555-0125", "[{0}] filed the complaint on Monday.", "[{0}]'s badge no longer works.", "Please forward it to [{0}] and wait.", "Mr. [{0}] asked for a refund.", "Mein Kollege Herr [{0}] ist krank.", "Die Unterlagen hat [{0}] gestern geschickt.",
    "Madame [{0}] est arrivée hier.", "Bonjour, je m'appelle [{0}].", "Buenos días, me llamo [{0}].", "El paquete es para la señora [{0}].", "Reviewed-by: [{0}] <a.b@example.org>", '{{"author": "[{0}]", "stars": 4}}', "Hello, my name is [{1}] and I lost my card.", "we thanked [{0}] and [{2}] for the help",
)
HAN_CARRIERS = ("联系人：[{0}]，电话13800138000。", "您好，我叫[{0}]，想改地址。", "收件人[{0}]。", "申请人：[{0}]")
PLAIN = ("The report lists 333 rows and 12 KB.", "Der Grenzwert steigt von 96 auf 120.", "ERROR scheduler: the test failed", "Install Docker and Kafka, then restart the Server.", "The Quick Start covers the Session Store.", "Die Sitzung und der Bericht liegen im Speicher.", "Le rapport est dans la file.", "La cola está vacía desde ayer.", "任务队列在周五重新启动。")


def test_persons_outside_any_list():
    """200 names that the library does not have, in five languages and two scripts: recall and precision of at least 0.9."""
    model, texts, truth = personal.train(), [], []
    for i in range(200):
        names = [f"{GIVEN[(i + k) % 20]} {FAMILY[(i * 7 + k) % 20]}" for k in (0, 3)]
        own = (names[0], names[0].lower(), names[1])
        marked = HAN_CARRIERS[i // 5 % 4].format(HAN[i % 20]) if i % 5 == 4 else CARRIERS[i % len(CARRIERS)].format(*own)
        text, spans = "", set()
        for part in re.split(r"(\[[^\]]*\])", marked):
            if part.startswith("["):
                part = part[1:-1]
                spans.add((len(text), len(text) + len(part)))
            text += part
        texts.append(text), truth.append(spans)
    got = [{(s, e) for s, e, k in own if k == "person"} for own in personal.found(texts + list(PLAIN), model)]
    both = sum(len(a & b) for a, b in zip(got, truth))
    recall, precision = both / sum(map(len, truth)), both / sum(map(len, got))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, [(t, b - a, a - b) for t, a, b in zip(texts, got, truth) if a != b][:12])


def test_other_types_and_edges():
    model = personal.train()
    texts = ["passport number AB1234567", "电话13912345678", "write to a.b at example dot org", "", None, "x" * 300_000 + " call 520-555-0125", "git@forge.example:a/b.git"]
    got = [[(t[s:e], k) for s, e, k in own] for t, own in zip(texts, personal.found(texts, model))]
    assert got == [[("AB1234567", "id_number")], [("13912345678", "phone")], [("a.b at example dot org", "email")], [], [], [("520-555-0125", "phone")], []]
