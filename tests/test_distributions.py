import numpy as np
import pytest

from factorlab.functions.distributions import f_critical, f_upper_tail, incomplete_beta, t_two_sided


@pytest.mark.parametrize("df, t", [(1, 12.7062), (5, 2.5706), (10, 2.2281), (30, 2.0423), (120, 1.9799)])
def test_t_table_at_five_percent(df, t):
    assert t_two_sided(t, df) == pytest.approx(0.05, abs=2e-5)


@pytest.mark.parametrize("df1, df2, f", [(1, 1, 161.45), (2, 10, 4.1028), (5, 10, 3.3258), (5, 60, 2.3683), (10, 120, 1.9105)])
def test_f_table_at_five_percent(df1, df2, f):
    assert f_critical(0.05, df1, df2) == pytest.approx(f, rel=1e-4)
    assert f_upper_tail(f, df1, df2) == pytest.approx(0.05, abs=2e-5)


def test_far_tail_keeps_its_precision():
    # Cauchy tail has a closed form; 1 - cdf would lose all digits here.
    assert t_two_sided(1e12, 1) == pytest.approx(2 / (np.pi * 1e12), rel=1e-9)
    assert t_two_sided(-3.0, 7) == t_two_sided(3.0, 7)


def test_t_is_f_with_one_degree():
    t = np.linspace(0.01, 8, 40)
    assert np.allclose(t_two_sided(t, 17), f_upper_tail(t * t, 1, 17), atol=1e-12)


def test_edges():
    assert incomplete_beta(2, 3, 0) == 0 and incomplete_beta(2, 3, 1) == 1
    assert np.isnan(incomplete_beta(2, 3, np.nan))
    assert np.isnan(f_critical(0.05, 2, -1))
