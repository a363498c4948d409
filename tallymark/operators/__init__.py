"""Retail operators.  Each takes a table and parameters, checks them against the schema when it is
built (no job runs), and has the result as ``.table`` (a DataFrame) and ``.df`` (pandas, kept)."""

from .base import Result
from .composite_rank import CompositeRank
from .cohort import CohortAnalysis
from .cross_shop import CrossShop
from .customer import DaysBetweenPurchases, PurchasesPerCustomer, TransactionChurn
from .decision_hierarchy import CustomerDecisionHierarchy
from .gain_loss import GainLoss
from .index import filter_by_groups, filter_by_value_thresholds, get_indexes, top_bottom
from .labels import filter_and_label_by_condition, label_by_condition
from .metrics import Acv, PctOfStores
from .periods import filter_and_label_by_periods, find_overlapping_periods, to_utc
from .product_association import ProductAssociation
from .revenue_tree import RevenueTree, calc_tree_kpis, tree_kpis
from .segmentation import HMLSegmentation, NLRSegmentation, RFMSegmentation, ThresholdSegmentation
from .segstats import SegTransactionStats

__all__ = [
    "Acv", "CohortAnalysis", "CompositeRank", "CrossShop", "CustomerDecisionHierarchy", "DaysBetweenPurchases", "GainLoss",
    "HMLSegmentation", "NLRSegmentation", "PctOfStores", "ProductAssociation", "PurchasesPerCustomer", "RFMSegmentation", "Result",
    "RevenueTree", "SegTransactionStats", "ThresholdSegmentation", "TransactionChurn", "calc_tree_kpis", "filter_and_label_by_condition",
    "filter_and_label_by_periods", "filter_by_groups", "filter_by_value_thresholds", "find_overlapping_periods", "get_indexes",
    "label_by_condition", "to_utc", "top_bottom", "tree_kpis",
]
