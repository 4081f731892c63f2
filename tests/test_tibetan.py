import pytest

from folioscan.functions import tibetan


@pytest.mark.parametrize(
    ("latin", "script"),
    [
        ("bla ma", "བླ་མ"), ("sangs rgyas", "སངས་རྒྱས"), ("bsgrubs", "བསྒྲུབས"), ("rgyal po", "རྒྱལ་པོ"), ("bkra shis bde legs", "བཀྲ་ཤིས་བདེ་ལེགས"), ("dga' ba", "དགའ་བ"), ("mtha'", "མཐའ"), ("pa'i", "པའི"), ("be'u", "བེའུ"),
        ("g.yag", "གཡག"), ("gyag", "གྱག"), ("'gro", "འགྲོ"), ("dbyangs", "དབྱངས"), ("brtsegs", "བརྩེགས"), ("lha sa", "ལྷ་ས"), ("rdo rje", "རྡོ་རྗེ"), ("spyan ras gzigs", "སྤྱན་རས་གཟིགས"), ("zla ba", "ཟླ་བ"), ("bod skad", "བོད་སྐད"), ("mkha' 'gro ma", "མཁའ་འགྲོ་མ"),
        ("oM ma Ni pad+me hU~M/", "ཨོཾ་མ་ཎི་པདྨེ་ཧཱུྃ།"), ("badz+ra", "བཛྲ"), ("a ma", "ཨ་མ"), ("ye shes", "ཡེ་ཤེས"), ("grwa", "གྲྭ"), ("phywa", "ཕྱྭ"), ("brgyad", "བརྒྱད"), ("bla ma/ dge", "བླ་མ། དགེ"), ("@#//_12", "༄༅།། ༡༢"), ("[abc] ka", "abc ཀ"), ("", ""), ("བོད", "བོད"),
    ],
)
def test_words(latin, script):
    assert tibetan.to_script(latin) == script


def test_columns(spark):
    rows = spark.createDataFrame([("bla ma",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(tibetan.script(rows["t"])).collect()] == ["བླ་མ", None, ""]
