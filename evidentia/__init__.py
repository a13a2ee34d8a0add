"""Bayesian-network and causal analytics on Spark DataFrames."""

from evidentia.operators.ace import AverageCausalEffect
from evidentia.operators.balance import ClassBalancer
from evidentia.operators.bn_features import NetworkFeatureGenerator
from evidentia.operators.causal_selector import CausalFeatureSelector
from evidentia.operators.layers import UnitImportance
from evidentia.operators.nmi_selector import NMIFeatureSelector
from evidentia.operators.outliers import TabularOutlierDetector
from evidentia.operators.selection import FirstKSelector, MarkovBlanketSelector
from evidentia.operators.sequences import SequenceOutlierDetector
from evidentia.operators.synth import SyntheticGenerator

__all__ = [
    "AverageCausalEffect",
    "CausalFeatureSelector",
    "ClassBalancer",
    "FirstKSelector",
    "MarkovBlanketSelector",
    "NMIFeatureSelector",
    "NetworkFeatureGenerator",
    "SequenceOutlierDetector",
    "SyntheticGenerator",
    "TabularOutlierDetector",
    "UnitImportance",
]
