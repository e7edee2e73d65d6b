"""Invoices of three shapes, with missing parts; empty bins of every unit."""

from decimal import Decimal

import pytest

from lakelens.operators import invoices as B
from lakelens.operators import timeseries as N

CII = """ <?xml version="1.0"?><rsm:CrossIndustryInvoice xmlns:rsm="a" xmlns:ram="b"><rsm:ExchangedDocument><ram:ID schemeID="s">C1</ram:ID><ram:IssueDateTime><ram:DateTimeString format="102">20240131</ram:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument>
<rsm:SupplyChainTradeTransaction><ram:IncludedSupplyChainTradeLineItem><ram:AssociatedDocumentLineDocument><ram:LineID>7</ram:LineID></ram:AssociatedDocumentLineDocument><ram:SpecifiedTradeProduct><ram:Name>Tea</ram:Name></ram:SpecifiedTradeProduct>
<ram:SpecifiedLineTradeDelivery><ram:BilledQuantity unitCode="H87">2</ram:BilledQuantity></ram:SpecifiedLineTradeDelivery><ram:SpecifiedLineTradeAgreement><ram:NetPriceProductTradePrice><ram:ChargeAmount>1.25</ram:ChargeAmount></ram:NetPriceProductTradePrice></ram:SpecifiedLineTradeAgreement>
<ram:SpecifiedLineTradeSettlement><ram:ApplicableTradeTax><ram:RateApplicablePercent>19</ram:RateApplicablePercent></ram:ApplicableTradeTax></ram:SpecifiedLineTradeSettlement></ram:IncludedSupplyChainTradeLineItem><ram:IncludedSupplyChainTradeLineItem/>
<ram:ApplicableHeaderTradeAgreement><ram:SellerTradeParty><ram:Name> Ann Ltd </ram:Name><ram:DefinedTradeContact><ram:EmailURIUniversalCommunication><ram:URIID schemeID="EM">a@x.org</ram:URIID></ram:EmailURIUniversalCommunication></ram:DefinedTradeContact></ram:SellerTradeParty><ram:BuyerTradeParty><ram:Name/></ram:BuyerTradeParty></ram:ApplicableHeaderTradeAgreement>
<ram:ApplicableHeaderTradeSettlement><ram:InvoiceCurrencyCode>CHF</ram:InvoiceCurrencyCode><ram:SpecifiedTradeSettlementPaymentMeans><ram:PayeePartyCreditorFinancialAccount><ram:IBANID>DE1</ram:IBANID></ram:PayeePartyCreditorFinancialAccount></ram:SpecifiedTradeSettlementPaymentMeans>
<ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:GrandTotalAmount>2.98</ram:GrandTotalAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement></rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>"""
UBL = """<Invoice xmlns:cbc="a" xmlns:cac="b"><cbc:ID>U1</cbc:ID><cbc:IssueDate>2024-02-01</cbc:IssueDate><cac:AccountingSupplierParty><cac:Party><cac:PartyName><cbc:Name>Bo</cbc:Name></cac:PartyName></cac:Party></cac:AccountingSupplierParty>
<cac:PaymentMeans><cac:PayeeFinancialAccount><cbc:ID>FR1</cbc:ID><cac:FinancialInstitutionBranch><cbc:ID>BIC1</cbc:ID></cac:FinancialInstitutionBranch></cac:PayeeFinancialAccount></cac:PaymentMeans>
<cac:LegalMonetaryTotal><cbc:TaxInclusiveAmount currencyID="EUR">12</cbc:TaxInclusiveAmount></cac:LegalMonetaryTotal><cac:InvoiceLine><cbc:LineExtensionAmount currencyID="EUR">10</cbc:LineExtensionAmount><cac:Item><cac:SellersItemIdentification><cbc:ID>sku</cbc:ID></cac:SellersItemIdentification></cac:Item></cac:InvoiceLine></Invoice>"""
FLAT = "<Invoice><InvoiceNumber>E1</InvoiceNumber><Seller><Name>Cy</Name></Seller><TotalAmount>many</TotalAmount><LineItem><ItemName>Pen</ItemName><Quantity>3</Quantity><UnitPrice>4</UnitPrice></LineItem></Invoice>"


def test_three_shapes(spark):
    rows = [(1, CII), (2, UBL), (3, FLAT), (4, None), (5, ""), (6, "<Invoice><ID>x"), (7, "<Invoice><ID> </ID></Invoice>"), (None, FLAT), (3, FLAT)]
    found = B.invoices(spark.createDataFrame(rows, "shape long, xml string"), "shape", "xml")
    got = {r.key: r.asDict(True) for r in found.collect()}
    assert found.count() == 5 and set(got) == {1, 2, 3, None}
    head = lambda k: tuple(got[k][c] for c in ("shape", "invoice_id", "issue_date", "seller", "buyer", "seller_email", "iban", "bic", "currency", "total"))
    assert head(1) == ("CII", "C1", "20240131", "Ann Ltd", None, "a@x.org", "DE1", None, "CHF", Decimal("2.98"))
    assert head(2) == ("UBL", "U1", "2024-02-01", "Bo", None, None, "FR1", "BIC1", "EUR", Decimal(12))
    assert head(3) == ("EN16931", "E1", None, "Cy", None, None, None, None, "EUR", None)
    line = lambda k: [tuple(x.values()) for x in got[k]["lines"]]
    assert line(1) == [("7", "Tea", 2, Decimal("1.25"), Decimal("1.25"), 19), ("2", None, 0, 0, 0, 0)]
    assert line(2) == [("1", "sku", 0, 10, 10, 0)] and line(3) == [("1", "Pen", 3, 4, 4, 0)]
    assert B.invoice_lines(found).count() == 6


def test_a_text_is_parsed_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, CII), (2, "<a/>")], "k long, xml string").write.parquet(str(tmp_path / "t"))
    written, keep = [], B.staged
    monkeypatch.setattr(B, "staged", lambda df, tag: (written.append(df), keep(df, tag))[1])
    assert [r.key for r in B.invoices(spark.read.parquet(str(tmp_path / "t")), "k", "xml").collect()] == [1]
    assert written[0]._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


@pytest.mark.parametrize(("unit", "last", "bins"), [("S", "2024-01-02 00:00:05", 86_406), ("H", "2024-01-03 01:00:00", 50), ("D", "2024-03-01 05:00:00", 61), ("W", "2024-01-20 00:00:00", 3), ("M", "2025-02-03 00:00:00", 14), ("Q", "2024-12-31 00:00:00", 4), ("Y", "2026-01-01 00:00:00", 3)])
def test_empty_bins(spark, unit, last, bins):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), (last, 2.0), (None, 3.0)], "at string, v double")
    got = N.resample(df, "at", "v", unit, "sum").orderBy("bin").collect()
    assert len(got) == bins == len({r.bin for r in got}) and [r.value for r in (got[0], got[-1])] == [1, 2] and sum(r.value for r in got) == 3
    assert N.resample(df.limit(0), "at", "v", unit).count() == 0
