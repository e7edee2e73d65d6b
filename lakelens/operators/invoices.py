"""Invoices in XML texts of three shapes, as header and line rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.sources.shared import staged

PARTY = "DefinedTradeContact struct<EmailURIUniversalCommunication:struct<URIID:string>>"
UBL_PARTY = "struct<Party:struct<Name:string,PartyName:struct<Name:string>,Contact:struct<ElectronicMail:string>>>"
# Element names of the three shapes (cross-industry, UBL, flat EN 16931).
SCHEMA = f"""
ExchangedDocument struct<ID:string,IssueDateTime:struct<DateTimeString:string>>,
SupplyChainTradeTransaction struct<
  ApplicableHeaderTradeAgreement:struct<SellerTradeParty:struct<Name:string,{PARTY}>,BuyerTradeParty:struct<Name:string,{PARTY}>>,
  ApplicableHeaderTradeSettlement:struct<InvoiceCurrencyCode:string,
    SpecifiedTradeSettlementPaymentMeans:array<struct<PayeePartyCreditorFinancialAccount:struct<IBANID:string>,PayeeSpecifiedCreditorFinancialInstitution:struct<BICID:string>>>,
    SpecifiedTradeSettlementHeaderMonetarySummation:struct<GrandTotalAmount:string>>,
  IncludedSupplyChainTradeLineItem:array<struct<AssociatedDocumentLineDocument:struct<LineID:string>,SpecifiedTradeProduct:struct<Name:string>,
    SpecifiedLineTradeDelivery:struct<BilledQuantity:string>,
    SpecifiedLineTradeAgreement:struct<NetPriceProductTradePrice:struct<ChargeAmount:string>,GrossPriceProductTradePrice:struct<ChargeAmount:string>>,
    SpecifiedLineTradeSettlement:struct<ApplicableTradeTax:struct<RateApplicablePercent:string>>>>>,
ID string, IssueDate string, DocumentCurrencyCode string, AccountingSupplierParty {UBL_PARTY}, AccountingCustomerParty {UBL_PARTY},
PaymentMeans array<struct<PayeeFinancialAccount:struct<ID:string,FinancialInstitutionBranch:struct<ID:string>>>>,
LegalMonetaryTotal struct<PayableAmount:string,TaxInclusiveAmount:string>,
InvoiceLine array<struct<ID:string,InvoicedQuantity:string,LineExtensionAmount:string,
  Item:struct<Name:string,BuyersItemIdentification:struct<ID:string>,SellersItemIdentification:struct<ID:string>,ClassifiedTaxCategory:struct<Percent:string>>,Price:struct<PriceAmount:string>>>,
InvoiceNumber string, Seller struct<Name:string>, Buyer struct<Name:string>, Currency string, TotalAmount string,
LineItem array<struct<ItemName:string,Quantity:string,UnitPrice:string,LineTotal:string,TaxCategory:string>>,
LineItems struct<LineItem:array<struct<ItemName:string,Quantity:string,UnitPrice:string,LineTotal:string,TaxCategory:string>>>
""".replace("\n", " ")  # fmt: skip


def first(*values: Column | str) -> Column:
    """The first that is not blank, trimmed; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(F.col(v) if isinstance(v, str) else v), F.lit("")) for v in values])


def amount(value: Column) -> Column:
    return value.try_cast("decimal(24,6)")


def invoices(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, shape, invoice_id, issue_date, seller, buyer, seller_email, buyer_email, iban, bic, currency, total, lines).

    The first shape whose number is there counts: CII, UBL, EN16931. Blank fields are null, the currency EUR; total is
    a decimal, null if it is no number. lines is an array of structs in the text's order (line_id, product, quantity,
    net_price, gross_price, vat): without a number a line has its place from 1, other figures default to 0, the net
    price to the line's amount, the gross price to the net price. Namespaces and attributes are ignored. Null, empty
    and broken texts and those without an invoice number give no row; other columns are left out. The texts should stand in a table: a
    long expression in their place is planned once for every field, which takes minutes. The rows are written to the
    shared folder once, so that what follows does not plan or parse them again.
    """
    text = F.regexp_replace(F.col(xml), r"\A[\s﻿]+", "")
    x = docs.where(F.col(xml).isNotNull()).select(F.col(key).alias("key"), F.from_xml(text, SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "excludeAttribute": "true"}).alias("x")).select("key", "x.*")
    deal = "SupplyChainTradeTransaction.ApplicableHeaderTradeAgreement"
    settle = "SupplyChainTradeTransaction.ApplicableHeaderTradeSettlement"
    zero = F.lit("0")

    def lines(source: Column, fields) -> Column:
        def row(v: Column, i: Column) -> Column:
            number, product, quantity, net, gross, vat = fields(v)
            place = (i + 1).cast("string")
            return F.struct(
                F.coalesce(first(*number), place).alias("line_id"), first(*product).alias("product"), amount(F.coalesce(first(*quantity), zero)).alias("quantity"),
                amount(F.coalesce(first(*net), zero)).alias("net_price"), amount(F.coalesce(first(*gross), first(*net), zero)).alias("gross_price"), amount(F.coalesce(first(*vat), zero)).alias("vat"),
            )

        return F.coalesce(F.transform(source, row), F.array().cast("array<struct<line_id:string,product:string,quantity:decimal(24,6),net_price:decimal(24,6),gross_price:decimal(24,6),vat:decimal(24,6)>>"))

    trade = lines(F.col("SupplyChainTradeTransaction.IncludedSupplyChainTradeLineItem"), lambda v: (
        [v["AssociatedDocumentLineDocument"]["LineID"]], [v["SpecifiedTradeProduct"]["Name"]], [v["SpecifiedLineTradeDelivery"]["BilledQuantity"]],
        [v["SpecifiedLineTradeAgreement"]["NetPriceProductTradePrice"]["ChargeAmount"]], [v["SpecifiedLineTradeAgreement"]["GrossPriceProductTradePrice"]["ChargeAmount"]],
        [v["SpecifiedLineTradeSettlement"]["ApplicableTradeTax"]["RateApplicablePercent"]],
    ))
    ubl = lines(F.col("InvoiceLine"), lambda v: (
        [v["ID"]], [v["Item"]["Name"], v["Item"]["BuyersItemIdentification"]["ID"], v["Item"]["SellersItemIdentification"]["ID"]], [v["InvoicedQuantity"]],
        [v["Price"]["PriceAmount"], v["LineExtensionAmount"]], [v["LineExtensionAmount"]], [v["Item"]["ClassifiedTaxCategory"]["Percent"]],
    ))
    flat = lines(F.coalesce("LineItem", "LineItems.LineItem"), lambda v: ([F.lit(None).cast("string")], [v["ItemName"]], [v["Quantity"]], [v["UnitPrice"]], [v["LineTotal"]], [v["TaxCategory"]]))
    supplier, customer, account = "AccountingSupplierParty.Party", "AccountingCustomerParty.Party", F.get("PaymentMeans", F.lit(0))["PayeeFinancialAccount"]
    means = F.get(f"{settle}.SpecifiedTradeSettlementPaymentMeans", F.lit(0))
    none = F.lit(None).cast("string")
    shapes = {
        "CII": (first("ExchangedDocument.ID"), "ExchangedDocument.IssueDateTime.DateTimeString", [f"{deal}.SellerTradeParty.Name"], [f"{deal}.BuyerTradeParty.Name"],
                f"{deal}.SellerTradeParty.DefinedTradeContact.EmailURIUniversalCommunication.URIID", f"{deal}.BuyerTradeParty.DefinedTradeContact.EmailURIUniversalCommunication.URIID",
                means["PayeePartyCreditorFinancialAccount"]["IBANID"], means["PayeeSpecifiedCreditorFinancialInstitution"]["BICID"], f"{settle}.InvoiceCurrencyCode",
                [f"{settle}.SpecifiedTradeSettlementHeaderMonetarySummation.GrandTotalAmount"], trade),
        "UBL": (first("ID"), "IssueDate", [f"{supplier}.PartyName.Name", f"{supplier}.Name"], [f"{customer}.PartyName.Name", f"{customer}.Name"], f"{supplier}.Contact.ElectronicMail", f"{customer}.Contact.ElectronicMail",
                account["ID"], account["FinancialInstitutionBranch"]["ID"], "DocumentCurrencyCode", ["LegalMonetaryTotal.PayableAmount", "LegalMonetaryTotal.TaxInclusiveAmount"], ubl),
        "EN16931": (first("InvoiceNumber"), "IssueDate", ["Seller.Name"], ["Buyer.Name"], none, none, none, none, "Currency", ["TotalAmount"], flat),
    }
    found = F.lit(None)
    for shape, (number, at, seller, buyer, seller_mail, buyer_mail, iban, bic, currency, total, items) in reversed(shapes.items()):
        one = F.struct(
            F.lit(shape).alias("shape"), number.alias("invoice_id"), first(at).alias("issue_date"), first(*seller).alias("seller"), first(*buyer).alias("buyer"), first(seller_mail).alias("seller_email"), first(buyer_mail).alias("buyer_email"),
            first(iban).alias("iban"), first(bic).alias("bic"), F.coalesce(first(currency), F.lit("EUR")).alias("currency"), amount(first(*total)).alias("total"), items.alias("lines"),
        )
        found = F.when(number.isNotNull(), one).otherwise(found)
    # Rows without an invoice go once they are written: before, the filter would parse the text anew for every field.
    return staged(x.select("key", found.alias("f")), "invoices").where("f is not null").select("key", "f.*")


def invoice_lines(found: DataFrame) -> DataFrame:
    """One row a line of what `invoices` gives: key, invoice_id and the line's fields."""
    return found.select("key", "invoice_id", F.inline("lines"))
