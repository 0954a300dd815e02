"""Recipes with the same views share one solved posterior."""

from panelwright.plans import queries, recipe_table


def test_one_recipe_of_each_kind_of_views_is_solved(spark, monkeypatch):
    solved, plain = [], recipe_table.solve_blocks

    def counted(settings, *args, **how):
        solved.append(settings.count())
        return plain(settings, *args, **how)

    monkeypatch.setattr(recipe_table, "solve_blocks", counted)
    out = queries._customer_batch(spark, "/root/testdata/sf0.01")
    asked = out["computed"].count()
    assert solved[0] < asked and out["posteriors"].select("config_id").distinct().count() == asked
    assert out["posteriors"].count() == asked * 6
