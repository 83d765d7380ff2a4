"""The test-table -> ERP-contract mapping, written as DuckDB CTEs.

Mirrors ``shopfloor/sources/testmap.py`` rule for rule.  Each constant is a
comma-separated list of ``name AS (...)`` CTE bodies that an oracle query
prefixes with ``WITH``.
"""

from shopfloor.sources import testmap as TM

INVENTORY = """
inventory_trans AS (
  SELECT o_orderkey AS InvTransID, o_orderdate AS InvTransDate,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              WHEN o_orderpriority = '1-URGENT' THEN 'EAST' ELSE 'MAIN' END AS LocationID
  FROM orders),
inventory_trans_detail AS (
  SELECT l_orderkey AS InvTransID, 'P' || CAST(l_partkey AS VARCHAR) AS PartNo,
         CASE WHEN l_linestatus = 'O' THEN '0000' ELSE '0001' END AS PartNoSuffix,
         CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_discount = 0 THEN 0.0
              ELSE -l_quantity END AS QuantityOnHandAdj
  FROM lineitem),
part_sfx AS (
  SELECT p.*, s.PartNoSuffix FROM part p, (VALUES ('0000'), ('0001')) s(PartNoSuffix)),
loc_off(LocationID, CurrencyCulture, off) AS (
  VALUES ('MAIN', 'en-US', 0.0::DOUBLE), ('EAST', 'en-CA', 10.0::DOUBLE)),
inventory AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS PartNo, PartNoSuffix,
         CAST(CASE WHEN p_size % 5 = 4 THEN NULL ELSE p_size % 5 END AS INTEGER) AS CostMethod,
         'EA' AS StockUOM, CASE WHEN p_size > 25 THEN 'BOX' ELSE 'EA' END AS CostUOM,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                     WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS CategoryID
  FROM part_sfx),
inventory_detail AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS PartNo, PartNoSuffix, l.LocationID,
         p_retailprice + l.off AS StdCost,
         p_retailprice * 0.9::DOUBLE + l.off AS AvgCost,
         CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_retailprice + 5.0::DOUBLE + l.off END AS LastCost
  FROM part_sfx, loc_off l),
locations AS (SELECT LocationID, CurrencyCulture FROM loc_off),
culture_currencies AS (SELECT CurrencyCulture AS CultureInfo FROM loc_off),
master_part_list AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS MasterPartNo, PartNoSuffix,
         'G' || CAST(p_partkey AS VARCHAR) || '-' || PartNoSuffix AS GUID, p_name AS Description
  FROM part_sfx),
categories(ID, Description) AS (
  VALUES (1, 'ECONOMY'), (2, 'LARGE'), (3, 'MEDIUM'), (4, 'PROMO'), (5, 'SMALL'), (6, 'STANDARD'))
"""

_LINES = f"""(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(TM.LINE_ORDER)}) AS l_pos FROM lineitem)"""
_KEY = TM.LINE_KEY

ORDERS = f"""
orders_m AS (
  SELECT o_orderkey AS oKey, 'SO' || CAST(o_orderkey AS VARCHAR) AS OrderNumber,
         o_orderdate AS Date, o_orderdate + INTERVAL 30 DAY AS ShipDate,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'O' THEN 1
                   WHEN o_orderpriority = '5-LOW' THEN 2 WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                   ELSE 0 END AS INTEGER) AS Status,
         CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 4
                   WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 3 END AS INTEGER) AS OrderType,
         'C' || CAST(o_custkey AS VARCHAR) AS CustomerID, '0' AS SiteID,
         CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'G' || CAST(o_custkey + 1 AS VARCHAR) END AS ProjectGUID,
         'E' || CAST(o_custkey % 128 AS VARCHAR) AS EnteredBy,
         'E' || CAST(o_orderkey % 97 AS VARCHAR) AS SalesPersonID,
         'REF' || CAST(o_orderkey AS VARCHAR) AS CustomerRef,
         'PO' || CAST(o_custkey AS VARCHAR) AS PONumber,
         'Contact ' || CAST(o_custkey AS VARCHAR) AS OrderContact,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS CurrencyMultiplier,
         o_totalprice * 0.07::DOUBLE AS TaxAmount,
         o_orderpriority AS Notes, 'NET30' AS Terms,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 45 DAY END AS CompleteDate,
         o_orderdate + INTERVAL 14 DAY AS ReqDate,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS AckDate,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 60 DAY
              WHEN o_orderpriority = '5-LOW' THEN NULL
              ELSE TIMESTAMP '1900-01-01 00:00:00' END AS ClosedDate,
         (o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P') AS Cancelled,
         'order ' || CAST(o_orderkey AS VARCHAR) AS Comments,
         'ship ' || CAST(o_custkey AS VARCHAR) AS ShpAddr_Comments,
         o_totalprice AS TotalPrice
  FROM orders),
order_detail AS (
  SELECT {_KEY} AS odKey, l_orderkey AS oKey,
         CAST(CASE WHEN l_discount >= 0.09 THEN 5 WHEN l_discount = 0 THEN NULL ELSE 4 END AS INTEGER) AS ItemType,
         CASE WHEN l_tax = 0.08 THEN l_orderkey * {TM.LINE_ROOM} END AS AlternativeODKey,
         'P' || CAST(l_partkey AS VARCHAR) AS PartNo,
         CASE WHEN l_linestatus = 'O' THEN '0000' ELSE '0001' END AS PartNoSuffix,
         CAST(l_shipdate AS DATE) AS PlanDate, l_linenumber AS LineItem,
         CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS SubLineItem,
         'SN' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_pos AS VARCHAR) AS SerialNumber,
         'line ' || CAST(l_linenumber AS VARCHAR) AS Comment,
         'LREF' || CAST(l_partkey AS VARCHAR) AS CustomerRef
  FROM {_LINES} AS lines)
"""

PART_SFX = """
part_sfx AS (
  SELECT p.*, s.PartNoSuffix FROM part p, (VALUES ('0000'), ('0001')) s(PartNoSuffix)),
master_part_list AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS MasterPartNo, PartNoSuffix,
         'G' || CAST(p_partkey AS VARCHAR) || '-' || PartNoSuffix AS GUID, p_name AS Description
  FROM part_sfx)
"""

DEMAND = f"""
iodq AS (
  SELECT {_KEY} AS odKey, 'P' || CAST(l_partkey AS VARCHAR) AS PartNo,
         CASE WHEN l_linestatus = 'O' THEN '0000' ELSE '0001' END AS PartNoSuffix,
         CASE WHEN l_suppkey % 2 = 0 THEN 'MAIN' ELSE 'EAST' END AS LocationID,
         CASE WHEN l_returnflag = 'N' THEN l_quantity WHEN l_returnflag = 'A' THEN l_quantity - 25 END
           AS QuantityOnSalesOrder
  FROM {_LINES} AS lines WHERE l_linestatus = 'O'),
ids_m AS (
  SELECT 'SN' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_pos AS VARCHAR) AS SerialNumber,
         'G' || CAST(l_suppkey AS VARCHAR) || '-0000' AS IssuePartGUID,
         CASE WHEN l_returnflag = 'R' THEN 'G' || CAST(l_partkey AS VARCHAR) || '-0001' END
           AS SecondaryIssuePartGUID,
         l_quantity AS IssuePartQty,
         CAST(CASE WHEN l_tax < 0.06 THEN 1 ELSE 0 END AS INTEGER) AS Status,
         CASE WHEN l_suppkey % 2 = 0 THEN 'MAIN' ELSE 'EAST' END AS LocationID
  FROM {_LINES} AS lines),
ir_m AS (
  SELECT {_KEY} AS odKey,
         CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE CAST(floor(l_quantity / 2) AS DOUBLE) END
           AS CompleteQty,
         l_quantity AS TotalQty
  FROM {_LINES} AS lines)
"""

BACKLOG = """
order_types(OrderType, Description) AS (VALUES (1, 'Sales'), (2, 'Quote'), (3, 'Credit'), (4, 'Service')),
customers AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS CustomerID, '0' AS SiteID,
         'G' || CAST(c_custkey AS VARCHAR) AS CustomerGUID, c_name AS Name, c_mktsegment AS SiteName
  FROM customer),
employees AS (
  SELECT 'E' || CAST(s_suppkey AS VARCHAR) AS EmployeeID, s_name AS LastName,
         'N' || CAST(s_nationkey AS VARCHAR) AS FirstName,
         CASE WHEN s_nationkey < 10 THEN 'MAIN' ELSE 'EAST' END AS LocationID
  FROM supplier),
order_relations AS (
  SELECT l_orderkey AS ChildoKey,
         CAST(CASE WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN 2 ELSE 1 END AS INTEGER) AS RelationType
  FROM lineitem WHERE l_returnflag = 'R'),
orders_open AS (
  SELECT 'SO' || CAST(l_orderkey AS VARCHAR) AS OrderNumber, CAST(l_shipdate AS DATE) AS TargetShipDate
  FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N'),
order_facts AS (
  SELECT l_orderkey AS oKey, SUM(l_quantity) AS IncQuantity, MAX(l_linestatus) AS Status,
         SUM(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS InvoiceAmount,
         SUM(l_extendedprice * (1 - l_discount)) AS Subtotal,
         SUM(l_quantity * 2.0::DOUBLE) AS TotalDimensions, SUM(l_quantity) AS QtyTotal,
         COUNT(1) AS ItemTotal, SUM(l_quantity * 1.5::DOUBLE) AS OrderWeight,
         2 AS DecimalPlaces, 'en-US' AS CultureInfo, 'EA' AS UOM
  FROM lineitem GROUP BY l_orderkey)
"""


def _sel(exprs, overrides=None) -> str:
    overrides = overrides or {}
    return ", ".join(f'{overrides.get(n, e)} AS "{n}"' for n, e in exprs)


def labels() -> str:
    cells = ", ".join(f"({i}, '{d}')" for i, d in TM.WORK_CELLS)
    return f"""
label_parts AS (SELECT {_sel(TM.label_part_exprs())} FROM {_LINES} AS lines),
opti_report_lites AS (
  SELECT {_sel(TM.LITE_EXPRS)} FROM {_LINES} AS lines
  UNION ALL
  SELECT {_sel(TM.LITE_EXPRS, TM.REMAKE_OVERRIDES)} FROM {_LINES} AS lines WHERE {TM.REMAKE_FILTER}),
order_detail_attributes AS (
  SELECT {_sel(TM.ATTRIBUTE_EXPRS)} FROM {_LINES} AS lines
  UNION ALL
  SELECT {_sel(TM.ATTRIBUTE_EXPRS, TM.EXTRA_ATTRIBUTE_OVERRIDES)} FROM {_LINES} AS lines
  WHERE {TM.EXTRA_ATTRIBUTE_FILTER}),
order_detail_plans AS (
  SELECT unnest(CASE WHEN l_linestatus = 'O' THEN [{TM.LINE_KEY}, {TM.FIRST_LINE_KEY[1:-1]}]
                     ELSE [{TM.FIRST_LINE_KEY[1:-1]}] END) AS odKey,
         {_sel(TM.PLAN_EXPRS)}
  FROM {_LINES} AS lines),
work_cells(ID, Description) AS (VALUES {cells}),
shortcuts AS (SELECT {_sel(TM.SHORTCUT_EXPRS)} FROM {_LINES} AS lines WHERE {TM.SHORTCUT_FILTER})
"""


def edge() -> str:
    lite_o = TM.EDGE_LITE.format(k="o_orderkey")
    lite_l = TM.EDGE_LITE.format(k="l_orderkey")
    slots = ", ".join(f"min(CASE WHEN l_linenumber = {k} THEN {TM.EDGE_TOKEN} END)" for k in TM.EDGE_LINES)
    attr_selects = []
    for attr, expr, cond in TM.ORDER_ATTRIBUTES:
        where = f" WHERE {cond}" if cond else ""
        attr_selects.append(f"SELECT o_orderkey AS item_id, '{attr}' AS name, {expr} AS value FROM orders{where}")
    gap_selects = [
        f"SELECT item_id, prefix || ' {s}' AS group_name, {e} AS code FROM gap_lines" for s, e in TM.GAP_CODES
    ]
    return f"""
gap_lines AS (
  SELECT l_orderkey AS item_id, 'LITE ' || ({lite_l}) || '.' || CAST(l_linenumber AS VARCHAR) AS prefix,
         min(l_quantity) AS mn_qty, max(l_discount) AS mx_disc, min(l_returnflag) AS mn_flag,
         min(l_linestatus) AS mn_status, min(l_tax) AS mn_tax
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
item_attributes AS (
  SELECT l_orderkey AS item_id, 'EW-STRAIGHT' AS name,
         concat_ws(',', {slots}) AS value
  FROM lineitem GROUP BY l_orderkey
  UNION ALL {' UNION ALL '.join(attr_selects)}),
item_group_codes AS (
  SELECT o_orderkey AS item_id, 'LITE ' || ({lite_o}) || ' GLASS' AS group_name, {TM.GLASS_CODE} AS code
  FROM orders
  UNION ALL {' UNION ALL '.join(gap_selects)}),
item_options AS (
  SELECT item_id, {TM.GAP_OPTION} AS option, prefix || ' OPTION' AS group_name FROM gap_lines)
"""
